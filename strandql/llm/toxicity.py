"""Toxicity by non-negative positive-unlabelled learning over hashed words and word beginnings.

Confirmed toxic rows of the training folds are the positives; every text of those folds is unlabelled. Features are a
text's distinct words and their first bytes (PREFIXES), as inflected words share a stem. Those of LEAST_TEXTS positive
texts are counted over all unlabelled texts by a grouped aggregation, and those whose share of positive texts differs
from their share of unlabelled ones by LEAST_Z standard errors enter the model. Linear classifiers over their presence
minimise prior * R+(g, 1) + max(0, R_u(g, 0) - prior * R+(g, 0)), stepping back where the bracket is negative. The
prior is the toxic share of all labelled training rows. All unlabelled texts, as the features they hold, are dealt into
shards of about SHARD_TEXTS; numpy trains CLASSIFIERS classifiers on each with all positives, and their weights are averaged by
texts. Only the positives are bounded: POSITIVES labelled rows. Every whole text is scored in one pass without a
shuffle. A word is known by a 64-bit hash, not by a bucket, so that a clean document's rare words do not fall on a
toxic word's weight.

Defined cases: null and empty texts have no word and get the score of the bias; very long texts are read whole; labels
that are null, not 0/1 or without a document are ignored; rows of one labelled id beyond common.ROWS_OF_ID are thinned
to about so many; repeated rows are scored one by one; ties have no order to decide; without a confirmed toxic row
every score is 0; a null doc_id belongs to the fold of the empty text, and is scored but not learned from; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandql.llm import bytefeat, common

POSITIVES, SHARD_TEXTS = 3000, 8192
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Features of the model: in so many positive texts at least (fewer where there are few), so many standard errors apart.
LEAST_TEXTS, LEAST_Z = 4, 5.0
CLASSIFIERS, STEPS, BATCHES = 3, 60, 6
#: Bytes handled at once; each makes several features of some numbers.
CHUNK = 1 << 18
#: Pairs of a text and a feature that are marked one by one rather than sorted.
MARKS = 1 << 23


def word_sets(texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, one past the last, hash of every feature, number of its text counted from the first)."""
    for at, to, buf, offsets in bytefeat.chunks(texts, CHUNK, lower=True):
        starts, ends = bytefeat.spans(buf, True)
        owner = np.searchsorted(offsets, starts, "right") - 1
        hashes, owners = [bytefeat.span_hashes(buf, starts, ends)], [owner]
        for size in PREFIXES:
            long = np.flatnonzero(ends - starts >= size)
            hashes.append(bytefeat.mix(bytefeat.span_hashes(buf, starts[long], starts[long] + size) + np.uint64(size)))
            owners.append(owner[long])
        yield at, to, np.concatenate(hashes), np.concatenate(owners)


class Known:
    """Sorted hashes of the features asked for, and which of them each text holds."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        # Where the hashes of each 20 leading bits begin: a feature is compared with these alone.
        self.begin = np.searchsorted(words >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.begin).max())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the hashes that are known, their places in words)."""
        bucket = (hashes >> np.uint64(44)).astype(np.int32)
        at, to = self.begin[bucket], self.begin[bucket + 1]
        todo = np.flatnonzero(at < to)
        found, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for _ in range(self.most):
            place = at[todo]
            same = self.words[place] == hashes[todo]
            found.append(todo[same])
            places.append(place[same])
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < to[todo]]
        return np.concatenate(found), np.concatenate(places)

    def places(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, one past the last, number of its text counted from the first, place in words), each pair once, in order."""
        n = max(len(self.words), 1)
        for at, to, words, owner in word_sets(texts):
            near, place = self.find(words)
            pair = owner[near] * n + place
            if (to - at) * n <= MARKS:
                marks = np.zeros((to - at) * n, bool)
                marks[pair] = True
                once = np.flatnonzero(marks)
            else:
                once = np.unique(pair)
            yield at, to, once // n, once % n


class Rows:
    """The known words of some texts, row by row."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        self.at = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
        self.n = len(texts)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.at], self.n)

    def back(self, grad: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, grad[self.row], size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, seed: int, *, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier: Adam on the non-negative risk with the logistic loss."""
    rng = np.random.default_rng(seed)
    w = np.zeros(size + 1)
    w[size] = np.log(prior / (1 - prior))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(STEPS):
        deal_p, deal_u = rng.permutation(len(positives)), rng.permutation(len(unlabelled))
        for k in range(BATCHES):
            p, u = Rows([positives[i] for i in deal_p[k::BATCHES]]), Rows([unlabelled[i] for i in deal_u[k::BATCHES]])
            if not p.n or not u.n:
                continue
            zp, zu = p.times(w) + w[size], u.times(w) + w[size]
            # logistic loss: for label 1 log(1 + exp(-z)), for label 0 log(1 + exp(z))
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gu, gp = _sigmoid(zu) / u.n, prior * _sigmoid(zp) / p.n
            if rest >= 0:
                to_p, to_u = prior * (_sigmoid(zp) - 1) / p.n - gp, gu
            else:
                to_p, to_u = gp, -gu
            grad = (p.back(to_p, size + 1) + u.back(to_u, size + 1)).astype(np.float64)
            grad[size] = to_p.sum() + to_u.sum()
            grad[:size] += decay * w[:size]
            t += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:size], float(w[size])


def feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text) to (word, n): in how many texts of a batch each feature is."""
    for batch in batches:
        for text_words in _in_tens([np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h, _ in word_sets([t]))])) for t in batch.column(1).to_pylist()]):
            words, n = np.unique(np.concatenate(text_words), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])


def _in_tens(rows: list) -> Iterator[list]:
    for k in range(0, len(rows), 10):
        yield rows[k : k + 10]


def counts_of(src: DataFrame, words: np.ndarray) -> tuple[int, np.ndarray]:
    """(texts of src, in how many of them each of the words is)."""
    known = src.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Known(known.value)
        total = np.zeros(len(own.words) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, _, _, place in own.places(batch.column(0).to_pylist()):
                total += np.bincount(place, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["place", "n"])

    found = src.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # a row a word
    total = np.zeros(len(words) + 1, np.int64)
    total[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return int(total[-1]), total[:-1]


def telling(p: np.ndarray, n_p: int, u: np.ndarray, n_u: int) -> np.ndarray:
    """Which features' shares of n_p positive and n_u unlabelled texts differ by LEAST_Z standard errors."""
    both = (p + u) / (n_p + n_u)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n_p + 1 / n_u))
    return np.abs(p / n_p - u / n_u) >= LEAST_Z * error


def train(positives: DataFrame, unlabelled: DataFrame, prior: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(sorted hashes of the features, weights, bias) from two tables of texts; the first of a bounded number of rows."""
    spark = positives.sparkSession
    positives = common.materialize(positives.select("doc_id", "text"), "positives")
    n_p = positives.count()
    if not n_p:
        return None
    least = min(LEAST_TEXTS, max(1, n_p // 4))
    found = positives.mapInArrow(feature_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()  # of POSITIVES texts
    words, p = found.column("word").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(words)
    words, p = words[order], p[order]
    n_u, u = counts_of(unlabelled, words)
    words = words[telling(p, n_p, u, max(n_u, 1))]
    known = spark.sparkContext.broadcast(words)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Known(known.value)
        for batch in batches:
            out = [b""] * batch.num_rows
            for at, to, row, places in own.places(batch.column(0).to_pylist()):
                cuts = np.searchsorted(row, np.arange(to - at + 1)).tolist()
                data = places.astype("<i4")
                for k in range(to - at):
                    out[at + k] = data[cuts[k] : cuts[k + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["places"])

    ready = positives.select("text").mapInArrow(place, "places binary").orderBy("places").toArrow().column(0).to_pylist()
    common.discard(positives)
    held = spark.sparkContext.broadcast([np.frombuffer(x, "<i4") for x in ready])  # POSITIVES texts

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(x, "<i4") for batch in batches for x in batch.column(0).to_pylist()]
        if own:
            made = [np.append(*fit(held.value, own, len(known.value), prior, 100 + k)) for k in range(CLASSIFIERS)]
            flat = np.mean(made, axis=0) * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat), pa.array([len(own)] * len(flat), pa.int64())], ["place", "total", "n"])

    dealt = unlabelled.select("text").mapInArrow(place, "places binary").repartition(max(1, round(n_u / SHARD_TEXTS)))
    sums = dealt.mapInArrow(shard, "place int, total double, n long").groupBy("place").agg((F.sum("total") / F.sum("n")).alias("w")).toArrow()  # a row a feature
    weights = np.zeros(len(words) + 1)
    weights[sums.column("place").to_numpy()] = sums.column("w").to_numpy()
    return words, weights[:-1], float(weights[-1])


def learn(docs: DataFrame, labels: DataFrame, *, held_out_fold: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float] | None:
    """(sorted hashes of the features, weights, bias) from the rows outside the held-out fold; None without a confirmed toxic one."""
    common.bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    in_fold = F.col("doc_id").isNotNull() & (common.fold_of(F.col("doc_id")) != held_out_fold)
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & in_fold)
    share = own.agg(F.avg("label").alias("prior"), F.sum("label").alias("n")).first()
    if not share["n"]:
        return None
    chosen = common.bounded_sample(own.where("label = 1").select("doc_id"), POSITIVES, "doc_id")
    return train(common.labelled_rows(src, chosen), src.where(in_fold), min(max(float(share["prior"]), 1e-4), 0.9))


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, held_out_fold: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; labels of the held-out fold are never seen."""
    model = learn(docs, labels, held_out_fold=held_out_fold, id_col=id_col, text_col=text_col, label_col=label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is not None:
            words, weights, bias = shared.value
            own = Known(words)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for at, to, row, place in own.places(batch.column(1).to_pylist()) if shared.value is not None else ():
                scores[at:to] = _sigmoid(np.bincount(row, weights[place], to - at) + bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    scored = src.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (common.fold_of(F.col("doc_id")) == held_out_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
