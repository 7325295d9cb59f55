import math
import random
import re
import unicodedata
from collections import Counter

import pytest

from strandql.llm import decision_list as d
from strandql.llm import simhash  # noqa: F401

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 30, "q w e r t z u i o p q w e r t z u i x", "l1\nl1\n\nl2\r\nl1\n  \n  \nl2\r", "é ü # $5 50% <b> & |x|", "😀 a\x0bb\x0cc d",
    " ".join(f"w{i % 50}" for i in range(500)), " ".join(f"v{i}" for i in range(2000)),
    " ".join(f"u{i}" for i in range(60_000)),
]


def test_counts(spark, make_docs):
    docs = make_docs(*enumerate(TEXTS))
    found = {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in d.text_counts(docs, "doc_id").collect()}
    for i, t in enumerate(TEXTS):
        assert found[i] == plain(t), (i, t)


def test_counts_of_the_sample(spark, sample):
    texts = {r["doc_id"]: r["text"] for r in sample("documents").where("length(text) < 6000").collect()}
    found = d.text_counts(sample("documents").where("length(text) < 6000"), "doc_id").collect()
    assert all(tuple(r[c] for c in COUNTS) == plain(texts[r["doc_id"]]) for r in found) and len(found) == len(texts)


def test_learned_list_is_ordered_conjunctions():
    # Bad where the first value is high, or where the second is low and the third high.
    cells = [((a, b, c), 5, 0) if a >= 3 or (b < 2 and c >= 2) else ((a, b, c), 0, 5) for a in range(5) for b in range(4) for c in range(4)]
    rules = d.learn_list(cells, cells, [4, 3, 3])
    verdict = lambda cell: any(all(c.holds(cell) for c in r) for r in rules)
    assert all(verdict(cell) == (bad > 0) for cell, bad, _ in cells) and len(rules) >= 2


def test_a_list_learns_nothing_from_nothing():
    assert d.learn_list([], [], [3, 3]) == [] and d.learn_list([((0, 0), 0, 9)], [], [3, 3]) == []


def test_query(spark):
    found = {r["doc_id"]: r for r in d.op4_decision_list(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    for r in found.values():
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    judged = [(found[x["doc_id"]]["kept"], x["quality"]) for x in labels if not found[x["doc_id"]]["base_failed"]]
    assert sum(k == bool(q) for k, q in judged) >= 0.97 * len(judged)
    assert all(k for k, q in judged if q)


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, make_docs, labelled):
    docs = make_docs((1, None), (1, None), (None, "word " * 3), (4, " ".join(f"v{i}" for i in range(60)))).withColumnRenamed("n_chars", "n_words").withColumnRenamed("lang", "label")
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (99, 1, 1), (None, 1, 0), (1, None, None)] if labelled else [], "doc_id long, quality int, toxic int")
    rows = sorted((str(r["doc_id"]), r["base_failed"], r["kept"]) for r in d.quality_rules(docs, labels).collect())
    assert rows == [("1", True, False), ("1", True, False), ("4", False, True), ("None", True, False)]
    kept = d.good_documents(docs, labels)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [4]
    assert d.quality_rules(docs.limit(0), labels).count() == 0


def plain_rates(text):
    n_words, chars, symbols, dup_lines, repeats = plain(text)
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    n = max(n_words, 1)
    return symbols / n, chars / n, upper / max(chars, 1), text.count("!") / n, repeats / n, dup_lines / max(len(lines), 1), len(set(words)) / n


def test_verdicts_against_brute_force(spark, sample):
    """Every document by the learned conjunctions, in order, on plainly counted rates."""
    docs, labels = sample("documents"), sample("labels")
    rules, edges = d.learn(docs, labels)
    assert rules
    found = {r["doc_id"]: r["kept"] for r in d.quality_rules(docs, labels).collect()}
    for r in docs.where("length(text) < 8000").collect():
        n_words, *_, repeats = plain(r["text"])
        rates = plain_rates(r["text"])
        rejected = any(all((rates[c.rate] > edges[c.rate][c.bin - 1]) == c.above for c in rule) for rule in rules)
        assert found[r["doc_id"]] == (not (n_words < 20 or 100 * repeats > 30 * n_words) and not rejected), r["doc_id"]


def test_best_condition_against_all_conditions():
    rng = random.Random(8)
    cells = [((rng.randrange(4), rng.randrange(3)), rng.randrange(6), rng.randrange(6)) for _ in range(30)]

    def gain(c):
        bad, good = (sum(x[k] for x in cells) for k in (1, 2))
        p, q = (sum(x[k] for x in cells if c.holds(x[0])) for k in (1, 2))
        return p * (math.log2(p / (p + q)) - math.log2(bad / (bad + good))) if p else 0.0

    every = [d.Condition(k, above, b) for k, n in enumerate((3, 2)) for b in range(1, n + 1) for above in (False, True)]
    assert gain(d._best_condition(cells, [], [3, 2])) == pytest.approx(max(map(gain, every)))
