"""Near-duplicate groups by SimHash, found with vantage-point trees over Hamming distance.

Fingerprints: 64 bits from the XXH64 hashes of a text's lower-cased word shingles. Equal fingerprints are merged
first, so any number of exact copies is one point. A vantage-point tree over a bounded sample of the points
decides the shards: a node with vantage point v and radius r sends a point p inside if d(p, v) <= r + k and
outside if d(p, v) > r. By the triangle inequality two points within k of each other always share a shard; the
points in the shell are those that query both sides. Each shard is searched by a tree of its own, down to blocks
that are compared exactly, and returns a spanning forest of its links, never all pairs of a group. A shard of points
too near each other to be parted is searched two blocks at a time. Components over all shards come from alternating
star rounds, each written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; a text of any length is read
whole; a bit set in exactly half the hashes is 0; repeated rows get a row each; a null doc_id never becomes a component id unless the whole component has none; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandql.llm import common

#: Points from which the tree over all shards is built: so many a shard, within these bounds. They reach the driver.
SHARD_SAMPLE, LEAST_SAMPLE, MOST_SAMPLE = 64, 16_384, 4_000_000
#: Points that a shard holds at most, about, and shards at least. The points that query both sides of a node grow with
#: the depth of the tree, so shards are as large as one task searches well.
SHARD_POINTS, LEAST_SHARDS = 262_144, 12
#: A block of so many points is compared pair by pair.
BLOCK_POINTS = 768


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(seed))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(digests), 1 << 16):
        ones += np.unpackbits(digests[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    common.bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---- vantage-point trees


def split_node(points: np.ndarray, near: int, rng: np.random.Generator) -> tuple[np.uint64, int, np.ndarray] | None:
    """(vantage point, radius, distances) of the most even split; None if no split leaves a tenth out on either side."""
    best = None
    for v in rng.choice(points, size=min(4, len(points)), replace=False):
        d = np.bitwise_count(points ^ v)
        upto = np.cumsum(np.bincount(d, minlength=65 + near))
        inside, outside = upto[near : 65 + near], len(points) - upto[:65]
        load = np.maximum(inside, outside)
        r = int(np.argmin(load))
        if best is None or load[r] < best[0]:
            best = (load[r], v, r, d)
    return None if best is None or best[0] > 0.9 * len(points) else best[1:]


def build_tree(points: np.ndarray, leaf: float, near: int, seed: int = 7) -> list[tuple]:
    """Nodes (vantage point, radius, inside child, outside child), or (None, leaf number, 0, 0); node 0 is the root."""
    rng, nodes, leaves = np.random.default_rng(seed), [], 0
    todo = [(points, None, 0)]
    while todo:
        own, parent, side = todo.pop()
        if parent is not None:
            nodes[parent][2 + side] = len(nodes)
        found = split_node(own, near, rng) if len(own) > leaf else None
        if found is None:
            nodes.append([None, leaves, 0, 0])
            leaves += 1
            continue
        v, r, d = found
        nodes.append([v, r, 0, 0])
        at = len(nodes) - 1
        todo += [(own[d > r], at, 1), (own[d <= r + near], at, 0)]
    return [tuple(n) for n in nodes]


def route(nodes: list[tuple], points: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, index of the point) for every shard that a point belongs to or queries."""
    shards, indexes = [], []
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, own = todo.pop()
        v, r, inside, outside = nodes[at]
        if v is None:
            shards.append(np.full(len(own), r, np.int32))
            indexes.append(own)
        elif len(own):
            d = np.bitwise_count(points[own] ^ v)
            todo += [(inside, own[d <= r + near]), (outside, own[d > r])]
    return np.concatenate(shards), np.concatenate(indexes)


def block_links(points: np.ndarray, own: np.ndarray, near: int, join) -> None:
    """Call join for the links of a spanning forest of these points: each point is compared with those not yet reached."""
    if len(own) <= BLOCK_POINTS:  # most blocks hold no link at all
        close = np.bitwise_count(points[own][:, None] ^ points[own][None, :]) <= near
        own = own[close.sum(axis=1) > 1]
    left = own
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            p = front.pop()
            hit = np.bitwise_count(points[left] ^ points[p]) <= near
            if hit.any():
                reached, left = left[hit], left[~hit]
                for q in reached.tolist():
                    join(p, q)
                front.extend(reached.tolist())


def shard_forest(points: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, smallest point of its component) for the points of a shard that are linked and not the smallest."""
    points = np.unique(points)
    parent = list(range(len(points)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a: int, b: int) -> None:
        a, b = find(int(a)), find(int(b))
        if a != b:
            parent[max(a, b)] = min(a, b)

    rng = np.random.default_rng(len(points))
    todo = [np.arange(len(points))]
    while todo:
        own = todo.pop()
        found = split_node(points[own], near, rng) if len(own) > BLOCK_POINTS else None
        if found is None:
            block_links(points, own, near, join)
        else:
            _, r, d = found
            todo += [own[d <= r + near], own[d > r]]
    roots = np.array([find(x) for x in range(len(points))], np.int64)
    moved = np.flatnonzero(roots != np.arange(len(points)))
    return points[moved], points[roots[moved]]


def links(points: DataFrame, near: int = 3, shard_points: int = SHARD_POINTS, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """u, v: a spanning forest, shard by shard, of all links between the distinct values of fp."""
    spark = points.sparkSession
    total = points.count()
    shard_points = min(shard_points, total / least_shards)
    sample_points = int(min(MOST_SAMPLE, max(LEAST_SAMPLE, SHARD_SAMPLE * total / max(shard_points, 1))))
    # Chosen by hash, so that the tree is the same in every run.
    sample = common.bounded_sample(points.select("fp"), sample_points, "fp").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    nodes = build_tree(sample, max(BLOCK_POINTS / 8, shard_points * min(1.0, len(sample) / max(total, 1))), near)
    shared = spark.sparkContext.broadcast(nodes)  # bounded by the sample

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            shard, at = route(shared.value, fp.view(np.uint64), near)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(fp[at])], ["shard", "fp"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = shard_forest(pdf["fp"].to_numpy(np.int64).view(np.uint64), near)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = common.materialize(points.select("fp").mapInArrow(deal, "shard int, fp long"), "shards")
    # A cluster of near points that no vantage point parts is one shard, however large. It is dealt into blocks, and every
    # two of them are searched together, so that no task holds more than a usual shard.
    room = max(2, int(shard_points) // 2)
    sizes = [(r["shard"], -(-r["count"] // room)) for r in dealt.groupBy("shard").count().collect() if r["count"] > 4 * room]  # of as many shards as leaves
    if not sizes:
        return dealt.groupBy("shard").applyInPandas(search, "u long, v long").distinct()
    parted = dealt.join(F.broadcast(spark.createDataFrame(sizes, "shard int, blocks long")), "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    parted = parted.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    parted = parted.select("shard", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp")
    return parted.groupBy("shard", "lo", "hi").applyInPandas(search, "u long, v long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest reachable node) for every node of the edges u, v, by large-star and small-star rounds."""
    edges = common.materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = common.materialize(small, "edges")
        common.discard(edges)
        edges = new
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out.folder = edges.folder  # type: ignore[attr-defined]
    return out


def near_duplicates(docs: DataFrame, near: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable), one row per row of docs."""
    rows = common.materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    points = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "points")
    roots = components(links(points, near))
    found = labelled(rows, points, roots)
    common.discard(points, roots)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def labelled(rows: DataFrame, points: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for rows (doc_id, fp); points: fp, rep (its smallest doc_id), n (its rows); roots: as components gives them."""
    of = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    of = of.join(of.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "n", "component_id")
    of = common.materialize(of, "classes")
    # A fingerprint with over a thousandth of all rows would make one large task of the join. There are fewer than a
    # thousand of them, so these few rows are broadcast; all other fingerprints are joined by key.
    most = max(1, rows.count() // 1000)
    hot = F.broadcast(of.where(F.col("n") > most).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot")))
    marked = rows.join(hot, "fp", "left")
    cold = marked.where("hot is null").join(of.where(F.col("n") <= most), "fp").select("doc_id", "fp", "component_id")
    return marked.where("hot").select("doc_id", "fp", F.col("hot_id").alias("component_id")).unionByName(cold)


def keep_one(docs: DataFrame, near: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document, that of the smallest id, of every group of near duplicates.

    Where one id stands on several rows, one of them stays. Documents without an id are left as they are.
    """
    return keep_first(docs, near_duplicates(docs, near, shingle, id_col, text_col), id_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose doc_id is not the component_id that found (doc_id, component_id) gives it."""
    found = common.materialize(found.select("doc_id", "component_id"), "groups")
    tally = found.where("doc_id is not null").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__lost")).distinct()
    kept = docs.join(lost, docs[id_col].cast("long") == F.col("__lost"), "left_anti")
    if tally["n"] == tally["d"]:
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))


def op3_vp_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
