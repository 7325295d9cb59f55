import random

import numpy as np
import pytest
import xxhash

from strandql.llm import simhash


def plain_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, near=3):
    """Smallest id of each component, by comparing all pairs. fps: (id, fingerprint)."""
    parent = {i: i for i, _ in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(fps):
        for j, b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= near:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


@pytest.mark.parametrize("text", ["", None, "one", "One two", "a b c", "a b c d a b c d", "\x0bq\x0cw\te\r\nr t", "é É ü x", "z " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_query_equals_brute_force(spark, sample):
    docs = [(r["doc_id"], r["text"]) for r in sample("documents").collect()]
    fps = [(i, plain_fingerprint(t)) for i, t in docs]
    roots = plain_components(fps)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op3_vp_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert found == {i: (f"{f:016x}", roots[i]) for i, f in fps}


def test_tree_and_shards_lose_no_link():
    rng = random.Random(5)
    points = set()
    for _ in range(300):  # clusters, chains, and points on their own
        p = rng.getrandbits(64)
        points.add(p)
        for _ in range(rng.choice([0, 0, 3, 12])):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                p ^= 1 << b
            points.add(p)
    points = np.array(sorted(points), np.uint64)
    want = plain_components([(int(p), int(p)) for p in points])
    nodes = simhash.build_tree(points[::3], 40, 3)
    assert sum(n[0] is None for n in nodes) > 4
    shard, at = simhash.route(nodes, points, 3)
    parent = {int(p): int(p) for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    block, simhash.BLOCK_POINTS = simhash.BLOCK_POINTS, 16
    try:
        for s in np.unique(shard):
            for a, b in zip(*simhash.shard_forest(points[at[shard == s]], 3)):
                a, b = find(int(a)), find(int(b))
                parent[max(a, b)] = min(a, b)
    finally:
        simhash.BLOCK_POINTS = block
    assert {int(p): find(int(p)) for p in points} == want


def test_tight_cluster_gives_a_forest_not_all_pairs():
    rng = np.random.default_rng(1)
    base = np.uint64(0x123456789ABCDEF)
    points = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)))
    u, v = simhash.shard_forest(points, 3)
    assert len(u) == len(points) - 1 and len(set(v.tolist())) == 1


def test_dense_clusters_are_searched_in_blocks(spark, monkeypatch):
    """Thousands of points within a few bits of one, which no vantage point parts, and others far from them."""
    rng = np.random.default_rng(6)
    base = np.uint64(0xF0F0123456789ABC)
    flips = lambda k: np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (2500, k)).astype(np.uint64), axis=1)
    points = np.unique(np.concatenate([base ^ flips(2), ~base ^ flips(2)[:700], base ^ flips(9), rng.integers(0, 1 << 63, 300, np.uint64)]))
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 3, shard_points=500, least_shards=1)).collect()}
    u, v = simhash.shard_forest(points, 3)
    assert len(np.unique(v)) > 1 and len(u) > 2000
    groups = lambda pairs: {frozenset(x) for x in pairs.values()}
    one, other = {}, {}
    for node, root in found.items():
        one.setdefault(root, {root}).add(node)
    for node, root in zip(u.view(np.int64).tolist(), v.view(np.int64).tolist()):
        other.setdefault(root, {root}).add(node)
    assert groups(one) == groups(other)


def test_components_of_long_chains(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100, 200), (200, 300), (-5, 300)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and found[100] == found[200] == found[300] == -5


def test_odd_rows(spark, make_docs):
    docs = make_docs((1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (7, "x " * 50_000), (8, " \t\n")).withColumnRenamed("n_chars", "fp")
    found = sorted((str(r["doc_id"]), r["fingerprint"] == "0" * 16, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert [(d, z) for d, z, _ in found] == [("1", True), ("2", True), ("3", False), ("3", False), ("7", False), ("8", True), ("None", False)]
    assert {d: c for d, _, c in found} == {"1": 1, "2": 1, "8": 1, "3": 3, "None": 3, "7": 7}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one(spark, make_docs):
    docs = make_docs((5, "a b c d e f g"), (2, "a b c d e f g"), (9, "quite another text here now"), (9, "quite another text here now"), (None, "q w e r t z u"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "9", "None"]
