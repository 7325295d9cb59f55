"""The near-dedup stage against the exact Jaccard similarity of all pairs."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from strandql.llm import jaccard

SF = "/root/testdata/sf0.01"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_roots(docs):
    """Smallest id of each component of pairs at 0.8 or more. docs: (id, text)."""
    sets, holders, shared = {i: plain_set(t) for i, t in docs}, defaultdict(list), Counter()
    for i, own in sets.items():
        for g in own or {b""}:
            holders[g].append(i)
    for own in holders.values():
        shared.update(combinations(own, 2))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if not sets[a] | sets[b] or n / len(sets[a] | sets[b]) >= 0.8:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_stage_equals_exact_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    roots = plain_roots([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == {i for i, root in roots.items() if i == root}


def test_borders_chains_and_odd_rows(spark, make_docs):
    words = [f"w{k}" for k in range(40)]
    at = lambda lo, hi: " ".join(words[lo:hi])
    rows = [(1, at(0, 20)), (2, at(0, 24)), (3, at(0, 29)), (4, at(0, 34)), (5, None), (6, " "), (7, "a b"), (8, "A  b"), (9, "a c")]
    rows += [(20 + k, f"x{k} " + at(5, 40)) for k in range(9)]  # pairs of these share 31 of 33
    roots = plain_roots(rows)
    assert roots[2] == 1 and roots[3] == 1 and roots[4] == 1 and roots[6] == 5 and roots[8] == 7 and roots[9] == 9
    found = jaccard.near_duplicates(make_docs(*rows, rows[0], (None, at(0, 20)))).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in found) == sorted([(str(i), r) for i, r in roots.items()] + [("1", 1), ("None", 1)])


def test_groups_beyond_a_block(spark, make_docs, monkeypatch):
    """A large group of different near copies, about half of whose pairs are below the similarity, in small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 8)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(rng.sample(base, 60))) for i in range(20)]
    roots = plain_roots(rows)
    assert 20 < len(set(roots.values())) < 80
    found = jaccard.near_duplicates(make_docs(*rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == roots


@pytest.mark.parametrize("columns", [3, 4096])
def test_comparison_of_sets(monkeypatch, columns):
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 12, rng.integers(0, 14))).astype(np.uint64) for _ in range(30)]
    near = jaccard.alike(sets, list(range(20)), list(range(10, 30)), 0.5)
    for i in range(20):
        for j in range(20):
            a, b = set(sets[i].tolist()), set(sets[10 + j].tolist())
            assert near[i, j] == (not a | b or len(a & b) / len(a | b) >= 0.5)


def test_empty_table(spark, make_docs):
    docs = make_docs((1, "a"))
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0
    assert jaccard.keep_one(docs.limit(0)).columns == docs.columns
