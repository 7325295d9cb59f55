"""Supervised subword embeddings for text quality: hashed word and character n-gram vectors, averaged, softmax.

Each word, each n-gram of GRAMS characters within or at the edge of a word, and each word that repeats its predecessor is
hashed to one of BUCKETS learned vectors; a document is the mean of its features' vectors; a softmax layer gives the
class. Training is numpy stochastic gradient descent on the driver over at most TRAIN_DOCS labelled rows and
TRAIN_BYTES of their (whole-text) feature counts. Scores need only the vectors' products with the output layer, one
number a bucket, so every whole text is scored in one pass without a shuffle.

Defined cases: null and empty texts have no feature and get the score of the output bias; very long texts are read
whole; labels that are null or not 0/1, and labels without a document, are ignored; a document labelled twice counts
twice; rows of one labelled id beyond common.ROWS_OF_ID are thinned to about so many; repeated rows are scored one by
one; ties have no order to decide; without labels every score is 0.5; a null doc_id belongs to the fold of the empty
text; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandql.llm import bytefeat, common

BUCKETS = 1 << 16
GRAMS = (3, 4)
DIM = 16
TRAIN_DOCS = 4000
TRAIN_BYTES = 128 << 20
EPOCHS, RATE = 6, 4.0


def features(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, one past the last, bucket of every feature, number of its text counted from the first)."""
    for at, to, buf, offsets in bytefeat.chunks(texts):
        starts, ends = bytefeat.spans(buf, False)
        words = bytefeat.span_hashes(buf, starts, ends)
        owner = np.searchsorted(offsets, starts, "right") - 1
        again = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1])) + 1
        buckets, owners = [words % np.uint64(BUCKETS - 1) + np.uint64(1), np.zeros(len(again), np.uint64)], [owner, owner[again]]
        chars = bytefeat.characters(buf)
        for size in GRAMS:
            place, end, gram = bytefeat.inner_grams(buf, size, chars)
            own = np.searchsorted(offsets, place, "right") - 1
            whole = end <= offsets[own + 1]
            buckets.append(gram[whole] % np.uint64(BUCKETS - 1) + np.uint64(1))
            owners.append(own[whole])
        yield at, to, np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (label, text) to (label, bytes): the buckets and counts of each text, as u16 and f32."""
    for batch in batches:
        out = []
        for _, _, buckets, owner in (f for t in batch.column(1).to_pylist() for f in features([t or b""])):
            counts = np.bincount(buckets, minlength=BUCKETS)
            at = np.flatnonzero(counts)
            out.append(at.astype("<u2").tobytes() + counts[at].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["label", "counts"])


def train(rows: list[tuple[int, bytes]], seed: int = 13) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): what a feature adds to the log odds of label 1 before the mean is taken."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    docs = []
    for label, data in rows:
        n = len(data) // 6
        counts = np.frombuffer(data, "<f4", n, 2 * n)
        if n:
            docs.append((label, np.frombuffer(data, "<u2", n).astype(np.int64), counts / counts.sum()))
    for epoch in range(EPOCHS):
        for step, k in enumerate(rng.permutation(len(docs))):
            label, at, share = docs[k]
            rate = RATE * (1 - (epoch * len(docs) + step) / (EPOCHS * len(docs)))
            mean = share @ vectors[at]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= rate * 0.1 * np.outer(mean, p)
            bias -= rate * 0.005 * p
            vectors[at] -= (rate * share)[:, None] * back
    return ((vectors @ out) @ np.array([-1, 1], np.float32)).astype(np.float64), float(bias[1] - bias[0])


def learn(docs: DataFrame, labels: DataFrame, *, held_out_fold: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """(score of each bucket, bias) from a bounded number of labelled rows outside the held-out fold."""
    common.bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    own = own.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (common.fold_of(F.col("doc_id")) != held_out_fold))
    chosen = common.bounded_sample(own, TRAIN_DOCS, "doc_id", "label")
    labelled = common.labelled_rows(src, chosen).select("label", "text").mapInArrow(feature_counts, "label int, counts binary")
    rows, held = [], 0
    ready = common.materialize(labelled, "labelled")
    for row in ready.orderBy(F.xxhash64("counts")).toLocalIterator():
        held += len(row["counts"])
        if held > TRAIN_BYTES:
            break
        rows.append((row["label"], bytes(row["counts"])))
    common.discard(ready)
    return train(rows) if rows else (np.zeros(BUCKETS), 0.0)


def quality_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, held_out_fold: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; labels of the held-out fold are never seen."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, held_out_fold=held_out_fold, id_col=id_col, text_col=text_col, label_col=label_col))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            logits = np.full(batch.num_rows, bias)
            for at, to, buckets, owner in features([t or b"" for t in batch.column(1).to_pylist()]):
                n = np.bincount(owner, minlength=to - at)
                logits[at:to] += np.bincount(owner, weights[buckets], to - at) / np.maximum(n, 1)
            scores = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    scored = src.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (common.fold_of(F.col("doc_id")) == held_out_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
