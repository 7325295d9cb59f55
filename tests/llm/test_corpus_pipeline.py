"""The whole pipeline against a plain version of what each stage decides."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from strandql.llm import common, decision_list, decontaminate, mixing
from tests.llm.test_decontaminate import plain_edits
from tests.llm.test_jaccard import plain_roots

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark, sample):
    docs = {r["doc_id"]: r for r in sample("documents").collect()}
    judged = {r["doc_id"]: r["kept"] for r in decision_list.quality_rules(sample("documents"), sample("labels")).collect()}
    left = {i: r for i, r in docs.items() if judged[i]}
    roots = plain_roots([(i, r["text"]) for i, r in left.items()])
    left = {i: r for i, r in left.items() if roots[i] == i}
    words = lambda t: [h for _, hs, _ in decontaminate.normal_words([t]) for h in hs.tolist()]
    items = [words(r["text"]) for r in sample("benchmark").collect()]
    own = {i: words(r["text"]) for i, r in left.items()}
    leaks = lambda b: any(len(set(a) - set(b)) <= int(0.2 * len(a)) and plain_edits(a, b) <= int(0.2 * len(a)) for a in items)
    left = {i: r for i, r in left.items() if not leaks(own[i])}
    mixed = mixing.taken_words(spark.createDataFrame(list(left.values()), sample("documents").schema)).collect()
    times = {r["doc_id"]: int(r["taken"] / max(r["size"], 1) + 0.5) for r in mixed}
    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in sorted(left):
        for _ in range(times[i]):
            ids = [*tokenizer.encode(left[i]["text"], add_special_tokens=False).ids, 1]
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    found = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1])
    assert found == want and len(want) > 50


def test_stages_keep_the_columns(spark, sample):
    docs = sample("documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def words(lo, hi):
    return " ".join(f"w{k}" for k in range(lo, hi))


def test_a_chain_of_odd_rows(spark, tmp_path):
    leak = " ".join(f"q{k}" for k in range(30))
    rows = [
        (1, words(0, 60), "en", "a", 1), (1, words(0, 60), "en", "a", 1), (2, words(0, 60), None, None, None), (None, words(100, 160), "en", "b", 1), (None, words(100, 160), "en", "b", 1),
        (4, None, "en", "a", 0), (5, "", "en", "a", 0), (6, "too short", "en", "a", 9), (7, words(200, 230) + " " + leak + " " + words(230, 260), "en", "a", 9), (8, words(300, 360), "de", None, 3), (9, words(400, 6400), "fr", "c", 3),
    ]
    docs = spark.createDataFrame([(*r, "x", 7, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, slot int, __id string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (8, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak), (1, leak), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, at = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = common.materialize(stage(spark, at, str(tmp_path)), "stage")
        assert at.columns == docs.columns
        seen[name] = sorted(str(r["doc_id"]) for r in at.collect())
    assert seen["quality rules"] == ["1", "1", "2", "7", "8", "9", "None", "None"]
    assert seen["near-dedup"] == ["1", "7", "8", "9", "None", "None"]
    assert seen["decontamination"] == ["1", "8", "9", "None", "None"]
    assert set(seen["mixing"]) == {"1", "8", "9", "None"}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == seen["mixing"]


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_a_chain_with_an_empty_table(spark, tmp_path, empty):
    for t, frame in (("documents", spark.createDataFrame([(k, words(60 * k, 60 * k + 60), "en", "s", 9) for k in range(4)], "doc_id long, text string, lang string, source string, n_chars long")), ("labels", spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, "not there at all in any text")], "item_id long, text string"))):
        (frame.limit(0) if t == empty else frame).write.parquet(f"{tmp_path}/{t}.parquet")
    before = set(os.listdir(common.shared_dir(spark).removeprefix("file:").replace("//", "/")))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in found.collect()) == ([] if empty == "documents" else [0, 1, 2, 3])
    left = set(os.listdir(common.shared_dir(spark).removeprefix("file:").replace("//", "/"))) - before
    assert {x.rsplit("-", 1)[0] for x in left} == {"stage"} and len(left) == 1  # what the stages stored is gone


def test_mixing_follows_the_schedule(spark, sample):
    """The stage's rows are those of the slots' order, and other points give another order."""
    docs = sample("documents").where("text is not null")
    first = [r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, SF).collect()]
    rank = {r["doc_id"]: r["first_slot"] for r in mixing.taken_words(docs).collect()}
    alone = [i for i in first if first.count(i) == 1]
    assert len(alone) > 20 and [rank[i] for i in alone] == sorted(rank[i] for i in alone)
