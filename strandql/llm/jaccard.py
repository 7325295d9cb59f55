"""Near-duplicate groups by the exact Jaccard similarity of word shingles: operator 3 carried to a similarity.

A text is the set of the XXH64 hashes of its lower-cased word shingles; texts of equal sets are merged first. Then come
the vantage-point trees of operator 3 over the texts' fingerprints: what they link within `near` bits is verified on the
sets. A radius that reaches a similarity of 0.8 would be a quarter of all bits, where trees prune nothing, so the pairs
beyond the trees' come from minimum hashes: BANDS keys of ROWS each; a pair at 0.8 shares no key with probability 3e-6
(0.59 to the power 24), a more similar one with less. A bucket is the texts of one key. Buckets of the same texts are
taken once, buckets whose texts the trees have linked already not at all.

All texts of a bucket are compared with each other, on the sets: a bucket is dealt into blocks of BLOCK_TEXTS, and a
task gets two blocks at a time, so no task ever holds more and no pair is a row; it returns a spanning forest of the
pairs at the similarity asked for. Texts with a bucket in common are few, and only their sets are ever made. A text of
a bucket of n texts is sent to n / BLOCK_TEXTS tasks: the work grows with the square of a group of different texts,
though by blocks. Components are those of all links; nothing is capped.

Defined cases: null and empty texts are the same empty set; a text shorter than a shingle is one shingle; very long
texts are taken whole, their sets in memory one pair of blocks at a time; repeated rows get a row each; null ids are as
in simhash; an empty table gives an empty result; ties have no order to decide; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandql.llm import common, simhash

BANDS, ROWS = 24, 4
#: Texts of a block; shingles that a comparison counts at a time.
BLOCK_TEXTS, COLUMNS = 256, 2048
#: Hashes of a text that are permuted at a time.
CHUNK = 1 << 14
_RNG = np.random.default_rng(20)
_FLIP = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_PRIME = np.uint64(0x9FB21C651E98DF25)


def shingle_digests(text: bytes | None, shingle: int) -> np.ndarray:
    """The bytes of the hashes of a text's shingles, repeats included, a row each."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.zeros((0, 8), np.uint8)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(42))), np.uint8).reshape(-1, 8)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_digests(text, shingle).view(">u8").astype(np.uint64).ravel())


def set_key(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).view(np.int64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band; texts whose minimum hashes of a band agree have the same."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), CHUNK):
        least = np.minimum(least, ((own[k : k + CHUNK] ^ _FLIP) * _ODD).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _PRIME
    for part in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ part) * _PRIME
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _bits(digests: np.ndarray) -> int:
    """The fingerprint of a text from its shingles' hashes (big-endian bytes, a row each), as a signed long."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(digests), 1 << 16):
        ones += np.unpackbits(digests[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.frombuffer(np.packbits(2 * ones > len(digests)).tobytes(), ">i8")[0])


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    common.bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def signed(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the row's set), fp (the fingerprint) and bands (none for an empty set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, bands = [], [], []
            for text in batch.column(1).to_pylist():
                digests = shingle_digests(text, shingle)
                own = np.unique(digests.view(">u8").astype(np.uint64).ravel())
                keys.append(set_key(own))
                prints.append(_bits(digests))
                bands.append(band_keys(own) if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(prints, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "fp", "bands"])

    return _read(docs, id_col, text_col).mapInArrow(run, "doc_id long, key long, fp long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """key, own (the set) of the keys in wanted (key, rep), from the texts of their representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "own"])

    reps = wanted.select(F.col("rep").alias("__rep")).distinct()
    texts = _read(docs, id_col, text_col)
    texts = texts.join(reps, texts["doc_id"].eqNullSafe(F.col("__rep")), "left_semi")
    # An id may stand on several rows, not all of which are asked for.
    return texts.mapInArrow(run, "key long, own binary").join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs u, v whose sets have that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                keep.append(alike([a, b], [0], [1], least)[0, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    held = pairs.join(sets.select(F.col("key").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("key").alias("v"), F.col("own").alias("b")), "v")
    return held.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def alike(sets: list[np.ndarray], rows: list[int], columns: list[int], least: float) -> np.ndarray:
    """Whether the similarity of the sets of these rows and columns is so large. sets: sorted distinct hashes."""
    sizes = np.array([len(x) for x in sets])
    if len(rows) == 1 and len(columns) == 1:
        a, b = sets[rows[0]], sets[columns[0]]
        small, large = sorted((len(a), len(b)))
        shared = np.array([[len(np.intersect1d(a, b, assume_unique=True)) if small >= least * large - 1 else 0]])
    else:
        _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        # A hash of one set alone is in no intersection; the others are numbered anew.
        common_one = times > 1
        number = np.cumsum(common_one) - 1
        kept = common_one[which]
        which, owner = number[which[kept]].astype(np.int32), owner[kept].astype(np.int32)
        order = np.argsort(which, kind="stable")
        which, owner = which[order], owner[order]
        del order, kept
        shared = np.zeros((len(rows), len(columns)), np.float32)  # exact up to 2^24 shingles, and by COLUMNS a step
        total = np.zeros((len(rows), len(columns)), np.int64)
        for lo in range(0, int(common_one.sum()), COLUMNS):
            at, to = np.searchsorted(which, (lo, lo + COLUMNS))
            holds = np.zeros((len(sets), COLUMNS), np.float32)
            holds[owner[at:to], which[at:to] - lo] = 1
            np.matmul(holds[rows], holds.T if len(columns) == len(sets) else holds[columns].T, out=shared)
            total += shared.astype(np.int64)
        shared = total
    either = sizes[rows][:, None] + sizes[columns][None, :] - shared
    return np.where(either > 0, shared / np.maximum(either, 1), 1.0) >= least


def _forest(near: np.ndarray, ids: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest, as (smallest id of a component, other id), of the links between rows and columns."""
    left = np.ones(len(ids), bool)
    is_row = np.zeros(len(ids), np.int64) - 1
    is_column = is_row.copy()
    is_row[rows], is_column[columns] = np.arange(len(rows)), np.arange(len(columns))
    linked = np.zeros(len(ids), bool)
    linked[rows] |= near.any(axis=1)
    linked[columns] |= near.any(axis=0)
    for first in np.flatnonzero(linked)[np.argsort(ids[linked], kind="stable")].tolist():
        if not left[first]:
            continue
        left[first] = False
        front = np.array([first])
        while len(front):
            reached = np.zeros(len(ids), bool)
            a, b = is_row[front], is_column[front]
            reached[columns] |= near[a[a >= 0]].any(axis=0)
            reached[rows] |= near[:, b[b >= 0]].any(axis=1)
            front = np.flatnonzero(reached & left)
            left[front] = False
            for k in front.tolist():
                yield int(ids[first]), int(ids[k])


def _compare(least: float):
    """From rows (bucket, lo, hi, key, block, own), sorted, to the links within each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, keys, blocks, sets = None, [], [], []

        def out() -> pa.RecordBatch:
            ids, block = np.array(keys, np.int64), np.array(blocks, np.int64)
            if unit[1] == unit[2]:
                rows = columns = np.arange(len(ids))
            else:
                rows, columns = np.flatnonzero(block == unit[1]), np.flatnonzero(block == unit[2])
            links = []
            if len(rows) and len(columns) and len(ids) > 1:
                near = alike(sets, rows, columns, least)
                if unit[1] == unit[2]:
                    np.fill_diagonal(near, False)
                links = list(_forest(near, ids, rows, columns))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["u", "v"])

        for batch in batches:
            for bucket, lo, hi, key, block, own in zip(*(c.to_pylist() for c in batch.columns)):
                if unit != (bucket, lo, hi):
                    if unit is not None:
                        yield out()
                    unit, keys, blocks, sets = (bucket, lo, hi), [], [], []
                keys.append(key)
                blocks.append(block)
                sets.append(np.frombuffer(own, np.uint64))
        if unit is not None:
            yield out()

    return run


def near_duplicates(docs: DataFrame, least: float = 0.8, shingle: int = 5, near: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the key of the set), component_id (the smallest doc_id reachable by pairs of that similarity), one row per row of docs."""
    marked = common.materialize(signed(docs, shingle, id_col, text_col), "signed")
    points = common.materialize(marked.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "points")
    rows = common.materialize(marked.select("doc_id", F.col("key").alias("fp")), "keys")
    common.discard(marked)
    linked = common.materialize(tree_links(points, near), "tree-links")
    shared = common.materialize(buckets(points), "buckets")
    wanted = common.materialize(shared.select("key").union(linked.select("u")).union(linked.select("v")).distinct().join(points.select("key", "rep"), "key"), "wanted")
    sets = common.materialize(sets_of(docs, wanted, shingle, id_col, text_col), "sets")
    edges = common.materialize(_verified(linked, sets, least), "verified")
    roots = simhash.components(edges)
    # Buckets whose texts the trees have linked are settled.
    placed = shared.join(roots.withColumnRenamed("node", "key"), "key", "left").select("bucket", "n", "key", F.coalesce("root", "key").alias("root"))
    open_ones = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    blocks = F.ceil(F.col("n") / BLOCK_TEXTS).cast("int")
    texts = shared.join(open_ones, "bucket", "left_semi").withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    texts = texts.select("bucket", "key", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    unit = [F.col("bucket"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    dealt = texts.select(*unit, "key", "block").join(sets, "key").select("bucket", "lo", "hi", "key", "block", "own")
    dealt = dealt.repartition(common.shuffle_width(docs.sparkSession), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    found = common.materialize(dealt.mapInArrow(_compare(least), "u long, v long").distinct(), "links")
    last = simhash.components(edges.union(found))
    out = simhash.labelled(rows, points.select(F.col("key").alias("fp"), "rep", "n"), last)
    common.discard(points, linked, shared, wanted, sets, edges, roots, found, last)
    return out


def tree_links(points: DataFrame, near: int) -> DataFrame:
    """u, v: the keys of texts that the trees link; points: key, fp. A fingerprint stands for its smallest key."""
    holders = common.materialize(points.groupBy("fp").agg(F.min("key").alias("holder")), "holders")
    forest = simhash.links(holders, near)
    for side in ("u", "v"):
        forest = forest.join(holders.select(F.col("fp").alias(side), F.col("holder").alias(f"key_{side}")), side)
    same = points.select("key", "fp").join(holders, "fp").where("key <> holder")
    return forest.select(F.col("key_u").alias("u"), F.col("key_v").alias("v")).union(same.select("holder", "key"))


def buckets(points: DataFrame) -> DataFrame:
    """bucket, n, key: the texts of every band key that several have. Of buckets of the same texts one is taken."""
    members = points.select("key", F.explode("bands").alias("bucket"))
    marks = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    found = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"), *marks).where("n > 1")
    one = found.groupBy("n", "least", "most", "mark0", "mark1").agg(F.min("bucket").alias("bucket"))
    return members.join(one.select("bucket", "n"), "bucket").select("bucket", "n", "key")


def keep_one(docs: DataFrame, least: float = 0.8, shingle: int = 5, near: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the document of the smallest id of every group; rows as in simhash.keep_one."""
    return simhash.keep_first(docs, near_duplicates(docs, least, shingle, near, id_col, text_col), id_col)
