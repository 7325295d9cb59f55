"""Benchmark decontamination: a CGK random-walk embedding, repeated bit-sampling LSH, exact edit verification.

Words are runs of letters and digits, lower-cased; in scripts that write no spaces each character is one. The CGK embedding of a window reads its words with a pointer:
step j emits the word at the pointer and moves on if a random function of (j, word) says so. Two walks that share
the random function fall back into step after an edit, so windows at a small edit distance get embeddings at a small
Hamming distance. A key is the hash of a few sampled positions of the leading steps; several samples are taken from
a walk, and walks are repeated with other random functions until simulated leaks with the largest edit distance
allowed are found at the target recall for the items of every length by itself; if that takes too many, it is an error. Every offset of an item is indexed, so a document needs a window at every few words only (the tier's stride). Whatever a key brings up is verified: the least word edit distance between the item and any
window of the document must be at most max_edit of the item's words. Items of fewer than MIN_WORDS words, of which
nothing may differ, are found by the hashes of their words in a row.

Documents are never shuffled. Items of the same words are one item, that of the smallest id; item_classes has them all.
Items go to the executors in blocks of bounded size; one pass over the documents takes PASS_BLOCKS of them. Defined
cases: null and empty texts match nothing, and items without a word are never matched; very long texts are matched
whole; repeated rows are judged one by one; null ids stay null; an empty table on either side gives no match; of the
places of one item the least distance is kept; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandql.llm import bytefeat, common

MIN_WORDS = 4
#: Words of items in a block; its keys take about 4 MB a walk (a longer item has a block of its own).
BLOCK_WORDS, PASS_BLOCKS = 1 << 16, 8
SAMPLES = 4
MAX_WALKS = 24
#: Simulated leaks of a length; lengths from WHOLE_LENGTHS words on are taken together by quarters of a power of two.
TRIALS, WHOLE_LENGTHS = 300, 24
_PRIME = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Tier:
    """How windows are walked: steps, positions in a key, distance of a document's windows; for items of least words."""

    least: int
    steps: int
    picks: int
    stride: int


#: Short items need shorter walks from more words.
TIERS = (Tier(24, 16, 8, 4), Tier(12, 12, 6, 2), Tier(MIN_WORDS, 6, 4, 1))


def normal_words(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, hashes of the words of some texts, offsets of the texts in them)."""
    data = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    for at, _, buf, offsets in bytefeat.chunks(data):
        starts, ends = bytefeat.single_characters(buf, *bytefeat.spans(buf, True))
        yield at, bytefeat.span_hashes(buf, starts, ends), np.searchsorted(starts, offsets)


def padded(hashes: np.ndarray, offsets: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts with a text's end standing so often behind each; where each text begins."""
    sizes = np.diff(offsets)
    begin = offsets[:-1] + steps * np.arange(len(sizes))
    out = np.zeros(len(hashes) + steps * len(sizes), np.uint64)
    out[np.arange(len(hashes)) + np.repeat(begin - offsets[:-1], sizes)] = hashes
    return out, begin


def walk_keys(words: np.ndarray, at: np.ndarray, tier: Tier, walk: int) -> np.ndarray:
    """Keys (SAMPLES, windows) of the windows that begin at these places."""
    own = bytefeat.mix(words ^ bytefeat.mix(np.array([walk + 1], np.uint64)))
    rng = np.random.default_rng((walk, tier.steps))
    chosen = [set(rng.choice(tier.steps, tier.picks, replace=False).tolist()) for _ in range(SAMPLES)]
    keys = np.empty((SAMPLES, len(at)), np.uint64)
    keys[:] = (np.arange(walk * SAMPLES, (walk + 1) * SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None] * _PRIME
    place = at.copy()
    for j in range(max(map(max, chosen)) + 1):
        seen = own[place]
        for k in range(SAMPLES):
            if j in chosen[k]:
                keys[k] = (keys[k] ^ seen) * _PRIME
        place += ((seen >> np.uint64(j)) & np.uint64(1)).astype(place.dtype)
    return keys ^ (keys >> np.uint64(29))


def least_edits(item: np.ndarray, words: np.ndarray, most: int) -> int:
    """The least edit distance between the item and any window of the words, if it is most or less; else most + 1.

    Each word of the item that the words lack costs an edit, which settles nearly all chance candidates. For the others
    come the rows of the usual table, vectorised.
    """
    if len(item) - np.isin(item, words).sum() > most:
        return most + 1
    row = np.zeros(len(words) + 1, np.int32)
    steps = np.arange(len(words) + 1, dtype=np.int32)
    for k, w in enumerate(item):
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (words != w))
        step[0] = k + 1
        row = np.minimum.accumulate(step - steps) + steps
    return min(int(row.min()), most + 1)


def run_keys(words: np.ndarray, n: int) -> np.ndarray:
    """A key of each n words in a row."""
    keys = np.full(max(len(words) - n + 1, 0), n, np.uint64)
    for k in range(n):
        keys = bytefeat.mix((keys ^ words[k : len(words) - n + 1 + k]) * _PRIME)
    return keys


def length_class(words: int) -> int:
    return words if words < WHOLE_LENGTHS else WHOLE_LENGTHS + int(4 * np.log2(words / WHOLE_LENGTHS))


@dataclass
class ItemBlock:
    """Some items and their keys, for every tier that has items: (tier, walks, sorted keys, item and offset of each, filter).

    short: for every number of words below MIN_WORDS that items have, the sorted keys of these items and their numbers.
    """

    ids: list
    words: list[np.ndarray]
    max_edit: float
    tiers: list[tuple] = field(default_factory=list)
    short: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)

    def allowed(self, item: int) -> int:
        return int(self.max_edit * len(self.words[item]) + 1e-9)

    def build(self, target_recall: float) -> ItemBlock:
        for n in range(1, MIN_WORDS):
            if own := [i for i, w in enumerate(self.words) if len(w) == n]:
                keys = np.concatenate([run_keys(self.words[i], n) for i in own])
                order = np.argsort(keys)
                self.short.append((n, keys[order], np.array(own)[order]))
        for n, tier in enumerate(TIERS):
            top = TIERS[n - 1].least if n else np.inf
            own = [i for i, w in enumerate(self.words) if tier.least <= len(w) < top]
            if not own:
                continue
            lengths: dict[int, list[int]] = {}
            for i in own:
                lengths.setdefault(length_class(len(self.words[i])), []).append(i)
            walks = 0
            while lengths:
                if walks == MAX_WALKS:
                    raise RuntimeError(f"{walks} walks do not reach a recall of {target_recall} for items of {sorted(len(self.words[i[0]]) for i in lengths.values())} words")
                walks += 1
                index = self._index(own, tier, walks)
                # A walk only adds candidates: what has reached the target stays there.
                lengths = {n: same for n, same in lengths.items() if self._recall(same, index) < target_recall}
            self.tiers.append(index)
        return self

    def _index(self, own: list[int], tier: Tier, walks: int) -> tuple:
        sizes = np.array([len(self.words[i]) for i in own])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        words, begin = padded(np.concatenate([self.words[i] for i in own]), offsets, tier.steps)
        counts = np.maximum(sizes - tier.steps // 2, 0) + 1
        which = np.repeat(np.arange(len(own)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        keys = np.concatenate([walk_keys(words, begin[which] + at, tier, w).ravel() for w in range(walks)])
        order = np.argsort(keys, kind="stable")
        times = walks * SAMPLES
        bits = np.zeros(1 << 20, bool)
        bits[keys >> np.uint64(44)] = True
        return tier, walks, keys[order], np.tile(np.array(own)[which], times)[order].astype(np.int32), np.tile(at, times)[order].astype(np.int32), bits

    def _recall(self, own: list[int], index: tuple) -> float:
        """Share of simulated leaks that are found: items with as many random edits as allowed, amid other words."""
        rng = np.random.default_rng(11)
        texts = []
        tried = [own[int(k)] for k in rng.integers(0, len(own), TRIALS)]
        for i in tried:
            words = self.words[i].tolist()
            for _ in range(self.allowed(i)):
                k, kind = int(rng.integers(0, len(words))), rng.integers(0, 3)
                words[k : k + int(kind != 0)] = [int(rng.integers(1, 1 << 62))] * int(kind != 1)
            around = rng.integers(1, 1 << 62, 20 + int(rng.integers(0, index[0].stride))).tolist()
            texts.append(np.array([*around, *words, *around], np.uint64))
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found = {(d, i) for d, i, _ in candidates(index, np.concatenate(texts), offsets)}
        return sum((d, i) in found for d, i in enumerate(tried)) / len(tried)


def candidates(index: tuple, hashes: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int, int]]:
    """(text, item, place of the item's first word) for every key that both have."""
    tier, walks, keys, item, offset, bits = index
    words, begin = padded(hashes, offsets, tier.steps)
    counts = -(-np.diff(offsets) // tier.stride)
    text = np.repeat(np.arange(len(counts)), counts)
    local = tier.stride * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    found: set[tuple[int, int, int]] = set()
    for lo in range(0, len(local), 1 << 15):
        t, at = text[lo : lo + (1 << 15)], local[lo : lo + (1 << 15)]
        for walk in range(walks):
            for own in walk_keys(words, begin[t] + at, tier, walk):
                hit = np.flatnonzero(bits[own >> np.uint64(44)])
                first = np.searchsorted(keys, own[hit])
                known = first < len(keys)
                hit, first = hit[known], first[known]
                same = keys[first] == own[hit]
                for h, f in zip(hit[same].tolist(), first[same].tolist()):
                    to = np.searchsorted(keys, keys[f], "right")
                    found.update((int(t[h]), int(i), int(at[h] - o)) for i, o in zip(item[f:to], offset[f:to]))
    return found


def short_leaks(block: ItemBlock, hashes: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
    """(text, item) of the items of fewer than MIN_WORDS words that a text holds."""
    found = set()
    for n, keys, items in block.short:
        own = run_keys(hashes, n)
        first = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        at = np.flatnonzero(keys[first] == own)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + n <= offsets[text + 1]
        for t, i, p in zip(text[inside].tolist(), items[first[at[inside]]].tolist(), at[inside].tolist()):
            if (t, i) not in found and (hashes[p : p + n] == block.words[i]).all():
                found.add((t, i))
    return found


def leaks(block: ItemBlock, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
    """(number of the text, number of the item, least edit distance) of every item that a text holds."""
    for at, hashes, offsets in normal_words(texts):
        places: dict[tuple[int, int], list[int]] = {}
        for index in block.tiers:
            for t, i, p in candidates(index, hashes, offsets):
                places.setdefault((t, i), []).append(p)
        for (t, i), own in sorted(places.items()):
            words, item, most = hashes[offsets[t] : offsets[t + 1]], block.words[i], block.allowed(i)
            own = sorted(own)
            best, lo = most + 1, own[0]
            for k, p in enumerate(own):
                after = own[k + 1] if k + 1 < len(own) else None
                if after is None or after - p > len(item) + 4 * most + 8:  # places near each other make one stretch
                    margin = 2 * most + 2
                    best = min(best, least_edits(item, words[max(0, lo - margin) : max(0, p + len(item) + margin)], most))
                    lo = after
            if best <= most:  # it may stand with fewer edits where no key led
                yield at + t, i, best and least_edits(item, words, best)
        for t, i in sorted(short_leaks(block, hashes, offsets)) if block.short else ():
            yield at + t, i, 0


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id and words (the hashes of its words) of every item that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: list[bytes] = []
            for _, hashes, offsets in normal_words(batch.column(1).to_pylist()):
                words += [hashes[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["item_id", "words"])
            yield made.filter(pa.array([len(w) > 0 for w in words], pa.bool_()))

    return items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "item_id long, words binary")


def item_classes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, same_as: for every item with a word the smallest id of the items of the same words, by which leaks name it."""
    own = item_words(items, id_col, text_col)
    return own.join(own.groupBy("words").agg(F.min("item_id").alias("same_as")), "words").select("item_id", "same_as")


def item_passes(items: DataFrame, max_edit: float, target_recall: float, id_col: str, text_col: str) -> Iterator[list[ItemBlock]]:
    """The different items in blocks of bounded size, so many blocks at a time, built one after the other on the driver."""
    made, ids, words, total = [], [], [], 0
    one = item_words(items, id_col, text_col).groupBy("words").agg(F.min("item_id").alias("item_id"))
    for row in one.orderBy("item_id", "words").toLocalIterator():
        own = np.frombuffer(row["words"], np.uint64)
        if ids and total + len(own) > BLOCK_WORDS:
            made.append(ItemBlock(ids, words, max_edit).build(target_recall))
            ids, words, total = [], [], 0
            if len(made) == PASS_BLOCKS:
                yield made
                made = []
        ids.append(row["item_id"])
        words.append(own)
        total += len(own)
    if ids:
        yield [*made, ItemBlock(ids, words, max_edit).build(target_recall)]


def find_leaks(docs: DataFrame, items: DataFrame, *, max_edit: float = 0.2, target_recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance (words), item_words: a row for each different item that a row of docs holds."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shape = "doc_id long, item_id long, distance int, item_words int"
    out = spark.createDataFrame([], shape)
    for blocks in item_passes(items, max_edit, target_recall, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(blocks)  # BLOCK_WORDS and PASS_BLOCKS bound it

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = [(ids[t], own.ids[i], d, len(own.words[i])) for own in shared.value for t, i, d in leaks(own, texts)]
                columns = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "distance", "item_words"])

        out = out.union(src.mapInArrow(run, shape))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, *, max_edit: float = 0.2, target_recall: float = 0.99, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds an item, all columns kept; nothing is shuffled."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    place = docs.columns.index(text_col)
    for blocks in item_passes(items, max_edit, target_recall, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep, texts = np.ones(batch.num_rows, bool), batch.column(place).to_pylist()
                for own in shared.value:
                    for t, _, _ in leaks(own, texts):
                        keep[t] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
