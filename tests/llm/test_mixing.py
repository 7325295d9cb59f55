import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from strandql.llm import mixing


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(mixing.OP8_SQL)
    names = [d[0] for d in want.description]
    rows = {r[0]: r for r in want.fetchall()}
    found = mixing.op8_golden_mix(spark, "/root/testdata/sf0.001").select(*names).collect()
    assert len(found) == len(rows)
    for r in found:
        w = rows[r[0]]
        assert tuple(r[:4]) == w[:4] and abs(r[4] - w[4]) < 1e-6 and tuple(r[5:]) == w[5:]


def plain_mix(rows, block, step=mixing.STEP):
    """taken, first slot and number of slots of each row (id, words, source), slot by slot."""
    names = sorted({r[2] for r in rows})
    sizes = [sum(r[1] for r in rows if r[2] == n) for n in names]
    words = [min(int(t + 0.5), 3 * z) for t, z in zip(plain_targets(sizes), sizes)]
    order = {n: sorted((r for r in rows if r[2] == n and r[1]), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[1])) for n in names}
    given, out = Counter(), {r[0]: [0, None, 0] for r in rows}
    for slot in range(-(-sum(sizes) // block)):
        point, upto = slot * step % mixing.POINTS, 0
        for k, n in enumerate(names):
            upto += words[k]
            if point < int(upto / sum(words) * mixing.POINTS):
                break
        lo = given[n] * block
        given[n] += 1
        at = 0
        for epoch in range(3):
            for r in order[n]:
                own = min(at + r[1], lo + block) - max(at, lo)
                if own > 0:
                    x = out[r[0]]
                    x[0], x[1], x[2] = x[0] + own, slot if x[1] is None else x[1], x[2] + 1
                at += r[1]
    return {k: tuple(v) for k, v in out.items()}


def test_rows_come_through_the_points(spark, make_docs, monkeypatch):
    rows = [(i, i * 7 % 31, f"s{i % 5 if i % 3 else 0}") for i in range(150)]
    docs = make_docs(*[(i, "w " * n, s) for i, n, s in rows])
    seen = []
    for step in (mixing.STEP, 1, 12345677):
        monkeypatch.setattr(mixing, "STEP", step)
        found = {r["doc_id"]: (r["taken"], r["first_slot"], r["n_slots"]) for r in mixing.taken_words(docs, block=16).collect()}
        assert found == plain_mix(rows, 16, step)
        seen.append(found)
    assert seen[0] != seen[1] and seen[0] != seen[2]


def plain_targets(sizes):
    """Water filling, step by step. sizes: by source, in order."""
    weights = [i % 3 + 1 for i in range(len(sizes))]
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > 3 * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
        left -= sum(target[i] for i in over)
        free -= set(over)
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 10, 5], [5, 5, 1000, 1, 70], [0, 50, 3], [7]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    found = [r["target"] for r in mixing.source_targets(df).orderBy("source_no").collect()]
    assert found == pytest.approx(plain_targets(sizes))


def test_each_source_meets_its_target_and_reruns_agree(spark, make_docs):
    docs = make_docs(*[(i, "w " * (i % 37), f"s{0 if i % 3 else i % 11}") for i in range(600)])
    first, again = (mixing.taken_words(docs, block=16) for _ in range(2))
    a, b = (sorted(map(tuple, x.collect())) for x in (first, again))
    assert a == b
    by = first.groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 4 * 16 for r in by)
    assert first.where("taken > 3 * size").count() == 0


def test_pieces_are_slots_of_equal_size_spread_evenly(spark, make_docs):
    docs = make_docs(*[(i, "w " * 40, "ab"[i % 2]) for i in range(200)])
    sizes, sources, pieces = mixing.mix_pieces(docs, block=32)
    slots = pieces.groupBy("slot").agg(F.sum("words").alias("n")).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(250)) and all(r["n"] == 32 for r in slots)
    named = pieces.join(sizes, "row").select("slot", "source").distinct().orderBy("slot").collect()
    # Weights 1 and 2: of any 30 slots in a row about 10 are of the first source.
    marks = [r["source"] == "a" for r in named[:240]]
    assert all(7 <= sum(marks[k : k + 30]) <= 13 for k in range(0, 210))


def test_odd_rows(spark, make_docs):
    docs = make_docs((1, None, "a"), (2, "", "a"), (3, "one two three", None), (3, "one two three", None), (None, "x y", "a"), (4, "z " * 60_000, "b")).withColumnRenamed("n_chars", "size").withColumnRenamed("lang", "row")
    rows = mixing.taken_words(docs, block=8).collect()
    assert len(rows) == 6 and sorted(r["size"] for r in rows) == [0, 0, 2, 3, 3, 60_000]
    assert all(r["taken"] <= 3 * r["size"] for r in rows) and {r["source"] for r in rows} == {"a", "b", None}
    assert mixing.taken_words(docs.limit(0)).count() == 0
    out = mixing.mixed_documents(docs, block=8)
    assert out.columns == docs.columns and out.where("doc_id in (1, 2)").count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_documents_come_in_the_order_of_their_slots(spark, make_docs):
    docs = make_docs(*[(i, f"{i} " * (1 + i % 40), f"s{i % 3}") for i in range(300)], (7, "7 " * 8, "s1"), (None, "x y z", "s0"), (None, "another one", "s0")).withColumnRenamed("lang", "__slot")
    sizes, _, pieces = mixing.mix_pieces(docs, block=8)
    read = pieces.join(sizes, "row").groupBy("doc_id", "mark", "epoch").agg(F.sum("words").alias("n"), F.min("slot").alias("slot"), F.max("size").alias("size"), F.count_distinct("row").alias("rows"))
    want = [r["doc_id"] for r in read.where("2 * n >= size * rows").orderBy("slot", "doc_id", "mark").collect() for _ in range(r["rows"])]
    out = mixing.mixed_documents(docs, block=8)
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == want


def test_resolution_follows_the_words():
    assert [mixing.block_words(n) for n in (0, 10, 1 << 17, 1 << 30)] == [1, 1, 2, 256]
