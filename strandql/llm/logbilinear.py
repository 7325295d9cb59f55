"""A log-bilinear language model, trained in numpy with noise-contrastive estimation over all training texts.

Tokens are lower-cased words and one end of text. Counts of all tokens come from a grouped aggregation. The model has
two levels. The first has the most frequent words, the end, and CLASSES classes (by the hash of a word's first two
bytes) of all other words as outputs: the two words before predict, with context vectors through one matrix a position,
a product with output vectors and a bias. The second gives a word within its class: each of the MODEL_WORDS most
frequent words has an output vector of its own, and each class one for all its words beyond these; the word before
predicts, through a third matrix. Among the words beyond MODEL_WORDS a word has its smoothed share of their counts. So
the probabilities of all words, unseen ones too, sum to one. Both levels are normalised exactly, by two tables made
once: matrix products of exponentials over all pairs of context words, and over all context words and classes. Scoring
a token takes table look-ups and one product of two vectors.

After a short start on the driver from a bounded number of texts, every partition trains on all its own texts, and the
parameters are averaged: those of the first level by tokens, a word's by how often a partition had it.

The MODEL_WORDS go to the executors; counts of all others are joined by word. Both are exact. A word of more than
KEY_BYTES bytes is known by a 128-bit hash and its length. Defined cases: null texts are empty, an empty text is its end
alone; very long texts are read whole; repeated rows are scored one by one; of words of one count on the border of the
model's those with the smallest hashes are in; a null doc_id is in the fold of the empty text; without any training text
N and V are 0 and the model is uniform; an empty table gives an empty result; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandql.llm import bytefeat, common

#: The end of a text among the words: no word holds white space.
END = b"\n"
#: Words with a vector of their own; a parameter of capacity, like DIM: all others share one vector a class.
MODEL_WORDS = 1 << 17
KEY_BYTES = 64
OUTPUTS, CLASSES, DIM = 2048, 64, 32
NOISE, INNER_NOISE, MINIBATCH, RATE, FLOOR, INNER_FLOOR = 64, 48, 8192, 0.05, 1e-8, 1e-9
#: Texts, and bytes of each at most, from which the driver makes the common starting point of all partitions.
START_TEXTS, START_BYTES = 400, 1 << 16
#: Distinct words that a worker counts before it passes them on.
FLUSH_WORDS = 200_000
#: Tokens that a partition trains on at least, and words or thousands of numbers that travel in one row.
TRAINER_TOKENS, PACK = 1 << 21, 4096
#: Tokens, about, that are scored in one step.
SCORED_TOKENS = 1 << 15


def word_class(word: bytes) -> int:
    return crc32(word[:2]) % CLASSES


def key_of(word: bytes) -> bytes:
    """The word, or for a long one a line break (which no word holds), its hash and its length."""
    import xxhash

    return word if len(word) <= KEY_BYTES else b"\n" + xxhash.xxh3_128_digest(word) + len(word).to_bytes(8, "big") + word[:2]


def class_of_key(key: bytes) -> int:
    return word_class(key[25:] if key[:1] == b"\n" and len(key) > 1 else key)


def tokens(text: bytes | None) -> list[bytes]:
    """The words as they are, and the end."""
    out = text.lower().split() if text else []
    out.append(END)
    return out


_CLASSES = np.array([[word_class(bytes([a, b])) for b in range(256)] for a in range(256)])
_CLASSES_ONE = np.array([word_class(bytes([a])) for a in range(256)])


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), c: of the column text (binary) of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            kinds = np.fromiter((crc32(w[:2]) for w in seen), np.int64, len(seen)) % CLASSES
            made = pa.RecordBatch.from_arrays([pa.array(map(key_of, seen), pa.binary()), pa.array(kinds, pa.int32()), pa.array(seen.values(), pa.int64())], ["word", "class", "c"])
            seen.clear()
            return made

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(tokens(text))
                if len(seen) > FLUSH_WORDS:
                    yield out()
        if seen:
            yield out()

    return texts.mapInArrow(run, "word binary, class int, c long").groupBy("word").agg(F.min("class").alias("class"), F.sum("c").alias("c"))


# ---- words


class Words:
    """The model's words: output number of each, place among the words of the second level, log10 of count + 0.5.

    The second level's places: the words that are no output of their own, by class, and behind each class's words one
    for all its others.
    """

    def __init__(self, counts: list[tuple[bytes, int]], class_totals: dict[int, tuple[int, int]]) -> None:
        """counts: the model's words, the most frequent first, END always among them; class_totals: (tokens, words) without END."""
        singles = [w for w, _ in counts if w != END][: max(OUTPUTS - CLASSES - 1, 0)] + [END]
        self.first_class = len(singles)
        self.outputs = len(singles) + CLASSES
        single = {w: i for i, w in enumerate(singles)}
        by_word = dict(counts)
        n, v = np.zeros(CLASSES), np.zeros(CLASSES)
        for k, (total, words) in class_totals.items():
            n[k], v[k] = total, words
        self.noise = np.zeros(self.outputs)
        for w in singles:
            c = by_word.get(w, 0)
            self.noise[single[w]] = c
            if c and w != END:  # the end is in no class
                n[class_of_key(w)] -= c
                v[class_of_key(w)] -= 1
        self.noise[len(singles) :] = n
        self.noise = (self.noise + 0.5) / (self.noise + 0.5).sum()
        self.number = {w: i for i, (w, _) in enumerate(counts)}
        self.table = bytefeat.SpanTable([w for w, _ in counts])
        self.end = self.number[END]
        self.known = np.array([c > 0 for _, c in counts] or [False])
        self.log_count = np.log10(np.array([c for _, c in counts] or [0]) + 0.5)
        kind = np.array([class_of_key(w) for w, _ in counts] or [0], np.int64)
        self.output = np.array([single.get(w, len(singles) + k) for (w, _), k in zip(counts, kind.tolist())] or [0], np.int64)
        # The second level.
        inner = np.flatnonzero(self.output >= len(singles))
        inner = inner[np.argsort(kind[inner], kind="stable")]
        size = np.bincount(kind[inner], minlength=CLASSES) + 1
        self.class_end = np.cumsum(size)
        self.class_begin = self.class_end - size
        self.place = np.zeros(len(self.output), np.int64)
        self.place[inner] = np.arange(len(inner)) + kind[inner]
        self.rest = self.class_end - 1
        self.mass = np.zeros(int(self.class_end[-1]))
        c = np.array([c for _, c in counts] or [0], np.float64)
        self.mass[self.place[inner]] = c[inner]
        n -= np.bincount(kind[inner], c[inner], CLASSES)
        v -= np.bincount(kind[inner], minlength=CLASSES)
        self.mass[self.rest] = n
        self.mass += 0.5
        #: log10 of the total that a word beyond the model's has its share of.
        self.log_rest = np.log10(n + 0.5 * (v + 1))
        total = np.add.reduceat(self.mass, self.class_begin)
        self.share = self.mass / np.repeat(total, size)
        self.inner_class = np.repeat(np.arange(CLASSES), size)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "number": {}}  # for tests; workers need the table only

    def read(self, texts: list[bytes | None]) -> Iterator[Read]:
        """The tokens of some texts at a time."""
        end = self.first_class - 1
        for at, to, buf, offsets in bytefeat.chunks(texts, lower=True):
            starts, ends = bytefeat.spans(buf, False)
            upto = np.searchsorted(starts, offsets)  # words before each text
            data, whole = buf.tobytes(), bytefeat.padded(buf)
            number = self.table.find(whole, data, starts, ends, key_of)
            kind = np.where(ends - starts > 1, _CLASSES[whole[starts], whole[starts + 1]], _CLASSES_ONE[whole[starts]])
            known = number >= 0
            out = np.where(known, self.output[number], self.first_class + kind)
            place = np.where(known, self.place[number], self.rest[kind])
            # Two starts before each text and the end behind it.
            n = to - at
            where = np.arange(len(starts)) + 3 * np.repeat(np.arange(n), np.diff(upto)) + 2
            last = upto[1:] + 3 * np.arange(n) + 2
            flat, places = np.full(len(starts) + 3 * n, self.outputs, np.int64), np.zeros(len(starts) + 3 * n, np.int64)
            flat[where], flat[last], places[where] = out, end, place
            real = np.flatnonzero(flat != self.outputs)
            yield Read(at, to, flat, real, places[real], number, kind, upto, starts, ends, data)


class Read(NamedTuple):
    """Tokens of the texts from at to to: outputs (two starts before each text), where the tokens are, their places; and of the words alone: numbers (or -1), classes, how many are before each text, and where they stand in data."""

    at: int
    to: int
    flat: np.ndarray
    real: np.ndarray
    place: np.ndarray
    number: np.ndarray
    kind: np.ndarray
    upto: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: bytes


# ---- model

LEVEL_ONE = ("R", "C1", "C2", "C3", "Q", "b")


def fresh_model(words: Words, dim: int = DIM, seed: int = 5) -> dict[str, np.ndarray]:
    """R: context vectors (the last is the start of a text), C1, C2 and C3: matrices, Q and b: vectors and biases of the first level's outputs; S: those of the second's, a bias behind each vector."""
    rng, outputs = np.random.default_rng(seed), words.outputs
    near = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    eye = np.eye(dim, dtype=np.float32)
    inner = np.zeros((len(words.share), dim + 1), np.float32)
    inner[:, -1] = np.log(words.share)
    return {
        "R": near(outputs + 1, dim), "C1": eye + near(dim, dim), "C2": eye * 0.5 + near(dim, dim), "C3": eye + near(dim, dim),
        "Q": near(outputs, dim), "b": np.log(words.noise).astype(np.float32),
        "S": inner,
    }


def _grouped(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different places, the sum of the values of each)."""
    order = np.argsort(at.astype(np.int16) if at.max(initial=0) < 1 << 15 else at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return own[first], np.add.reduceat(values[order], first, axis=0)


def _sum_rows(values: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros((rows, values.shape[1]), np.float32)
    places, sums = _grouped(values, at)
    out[places] = sums
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of x."""
    np.minimum(np.negative(x, out=x), 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive gradient steps (AdaGrad)."""

    def __init__(self, model: dict[str, np.ndarray], words: Words, seed: int) -> None:
        self.m = {k: v.copy() for k, v in model.items()}
        self.past = {k: np.full_like(v, INNER_FLOOR if k == "S" else FLOOR) for k, v in model.items()}
        self.words = words
        self.log_noise = np.log(NOISE * np.maximum(words.noise, 1e-12)).astype(np.float32)
        self.cumulated = np.cumsum(words.noise)
        self.log_share = np.log(INNER_NOISE * words.share).astype(np.float32)
        self.shares = np.cumsum(words.share)  # each class's have the sum one
        self.rng = np.random.default_rng(seed)
        self.seen = 0
        self.times = np.zeros(len(words.share), np.int64)

    def steps(self, flat: np.ndarray, real: np.ndarray, place: np.ndarray, size: int) -> None:
        """Steps of so many tokens; flat, real and place as sequences gives them."""
        for lo in range(0, len(real), size):
            own = real[lo : lo + size]
            self.step(flat[own[0] - 2 : own[-1] + 1], own - own[0] + 2, place[lo : lo + size])

    def step(self, flat: np.ndarray, real: np.ndarray, place: np.ndarray) -> None:
        w, w1, w2 = flat[real], flat[real - 1], flat[real - 2]
        m, n = self.m, len(w)
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE) * self.cumulated[-1], "right"), len(m["b"]) - 1)
        r1, r2 = m["R"][w1], m["R"][w2]
        h = r1 @ m["C1"] + r2 @ m["C2"]
        own, other = m["Q"][w], m["Q"][noise]
        g = _sigmoid(np.einsum("ij,ij->i", h, own) + m["b"][w] - self.log_noise[w]) - 1
        gn = _sigmoid(h @ other.T + (m["b"][noise] - self.log_noise[noise]))
        dh = g[:, None] * own + gn @ other
        outputs = len(m["b"])
        dq = _sum_rows(np.concatenate([g[:, None] * h, gn.T @ h]), np.concatenate([w, noise]), outputs)
        db = np.bincount(np.concatenate([w, noise]), np.concatenate([g, gn.sum(axis=0)]), outputs).astype(np.float32)
        d1 = dh @ m["C1"].T
        in_class = np.flatnonzero(w >= self.words.first_class)
        grads = {"Q": dq, "b": db, "C1": r1.T @ dh, "C2": r2.T @ dh}
        if len(in_class):
            d3, grads["C3"] = self._inner(r1[in_class], w[in_class] - self.words.first_class, place[in_class], n)
            d1[in_class] += d3
        # Each place is the last word of one token at most and the word before of another.
        at = np.zeros((len(flat), d1.shape[1]), np.float32)
        at[real - 1] = d1
        at[real - 2] += dh @ m["C2"].T
        grads["R"] = _sum_rows(at, flat, outputs + 1)
        for k, d in grads.items():
            d /= n
            self.past[k] += d * d
            m[k] -= RATE * d / np.sqrt(self.past[k])
        self.seen += n

    def _inner(self, r1: np.ndarray, kind: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Step of the second level; the gradients of the context vectors and of C3. All tokens of a class share its noise words."""
        m = self.m
        order = np.argsort(kind.astype(np.int16), kind="stable")
        r1, kind, place = r1[order], kind[order], place[order]
        u = np.concatenate([r1 @ m["C3"], np.ones((len(kind), 1), np.float32)], axis=1)
        here, first = np.unique(kind, return_index=True)
        drawn = np.searchsorted(self.shares, (here[:, None] + self.rng.random((len(here), INNER_NOISE)) * 0.999999).ravel(), "right").reshape(len(here), -1)
        drawn = np.clip(drawn, self.words.class_begin[here][:, None], self.words.class_end[here][:, None] - 1)
        own, other = m["S"][place], m["S"][drawn]
        shift = -self.log_share[drawn]
        g = _sigmoid(np.einsum("ij,ij->i", u, own) - self.log_share[place]) - 1
        du = g[:, None] * own
        dn = np.empty(other.shape, np.float32)
        for k, (lo, hi) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(kind)])):
            gn = _sigmoid(u[lo:hi] @ other[k].T + shift[k])
            du[lo:hi] += gn @ other[k]
            dn[k] = gn.T @ u[lo:hi]
        rows, d = _grouped(np.concatenate([g[:, None] * u, dn.reshape(-1, dn.shape[2])]), np.concatenate([place, drawn.ravel()]))
        d /= n
        # One step size a word: the mean of its squared gradients.
        past = self.past["S"][rows] + d * d
        self.past["S"][rows] = past
        m["S"][rows] -= d * (RATE / np.sqrt(past))
        self.times += np.bincount(place, minlength=len(self.times))
        back = np.empty(r1.shape, np.float32)
        back[order] = du[:, :-1] @ m["C3"].T
        return back, r1.T @ du[:, :-1]


def tables(model: dict[str, np.ndarray], words: Words) -> dict[str, np.ndarray]:
    """What scoring looks up.

    one, two: what the last word and the word before bring to the first level; norm: the log normaliser of every pair of
    context words; u: what the last word brings to the second level; inner: its log normaliser by last word and class;
    Q, b, S.
    """
    one, two = model["R"] @ model["C1"], model["R"] @ model["C2"]
    g1, g2 = one @ model["Q"].T + model["b"], two @ model["Q"].T
    top1, top2 = g1.max(axis=1, keepdims=True), g2.max(axis=1, keepdims=True)
    z = np.empty((len(g1), len(g2)), np.float32)
    other = np.exp(g2 - top2).astype(np.float64).T
    for lo in range(0, len(g1), 256):
        own = slice(lo, lo + 256)
        z[own] = np.log(np.exp(g1[own] - top1[own]).astype(np.float64) @ other) + top1[own] + top2.T
    u = model["R"] @ model["C3"]
    inner = np.zeros((len(u), CLASSES), np.float32)
    for k, (lo, hi) in enumerate(zip(words.class_begin.tolist(), words.class_end.tolist())):
        for at in range(0, len(u), 128):
            scores = u[at : at + 128] @ model["S"][lo:hi, :-1].T
            scores += model["S"][lo:hi, -1]
            top = scores.max(axis=1, keepdims=True)
            scores -= top
            inner[at : at + 128, k] = np.log(np.exp(scores, out=scores).sum(axis=1, dtype=np.float64)) + top[:, 0]
    return {"one": one, "two": two, "norm": z, "u": u, "inner": inner, "Q": model["Q"], "b": model["b"], "S": model["S"]}


def log_probabilities(words: Words, made: dict[str, np.ndarray], read: Read) -> np.ndarray:
    """Natural log probability of each text's outputs and places; a word beyond the model's counts as its class's others."""
    total = np.zeros(read.to - read.at)
    owner = np.repeat(np.arange(len(total)), np.diff(read.upto) + 1)
    for lo in range(0, len(read.real), SCORED_TOKENS):
        real, place = read.real[lo : lo + SCORED_TOKENS], read.place[lo : lo + SCORED_TOKENS]
        w2, w1, w = read.flat[real - 2], read.flat[real - 1], read.flat[real]
        score = np.einsum("ij,ij->i", made["one"][w1] + made["two"][w2], made["Q"][w]).astype(np.float64) + made["b"][w] - made["norm"][w1, w2]
        own = np.flatnonzero(w >= words.first_class)
        before, vectors = w1[own], made["S"][place[own]]
        score[own] += np.einsum("ij,ij->i", made["u"][before], vectors[:, :-1]) + vectors[:, -1] - made["inner"][before, w[own] - words.first_class]
        total += np.bincount(owner[lo : lo + SCORED_TOKENS], score, len(total))
    return total


# ---- training on all texts


#: Kinds of rows of parameters: of the first level, of words as a trainer has them, of words added up.
FIRST, TRAINED, SUMMED = 0, 1, 2


def _started(words: Words, begun: tuple) -> Trainer:
    """A trainer from the common starting point, of which only what differs from a fresh model travels."""
    model, past, at, moved, moved_past = begun
    own = Trainer({**fresh_model(words), **model}, words, 17)
    own.past.update({k: v.copy() for k, v in past.items()})
    own.m["S"][at], own.past["S"][at] = moved, moved_past
    return own


def _packed(own: Trainer, begun: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A trainer's parameters in rows (part, kind, chunk, places, weights, numbers).

    The first level's go by tokens; of the second only the words that the trainer met, by their times and as differences
    from where they began, in half precision.
    """
    part = TaskContext.get().partitionId()
    flat = np.concatenate([own.m[k].ravel() for k in LEVEL_ONE])
    for k in range(-(-len(flat) // PACK)):
        yield _row((part, FIRST, k), b"", np.array([own.seen], "<f8"), flat[k * PACK : (k + 1) * PACK].astype("<f8") * own.seen)
    for k in range(-(-len(own.times) // PACK)):
        at = np.flatnonzero(own.times[k * PACK : (k + 1) * PACK])
        if len(at):
            moved = own.m["S"][k * PACK + at] - begun[k * PACK + at]
            yield _row((part, TRAINED, k), at.astype("<u2").tobytes(), own.times[k * PACK + at].astype("<f4"), np.clip(moved, -6e4, 6e4).astype("<f2"))


PACKED = "part int, kind int, chunk int, places binary, weights binary, numbers binary"


def _row(at: tuple[int, int, int], places: bytes, weights: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    values = (*at, places, weights.tobytes(), numbers.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "kind", "chunk", "places", "weights", "numbers"])


def _added(width: int):
    """Sums of the rows of each (part, whether of the first level, chunk); the rows come sorted by these. width: numbers of a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights, sums = None, None, None

        def out() -> pa.RecordBatch:
            if not at[1]:
                return _row((at[0], FIRST, at[2]), b"", weights, sums)
            there = np.flatnonzero(weights)
            return _row((at[0], SUMMED, at[2]), there.astype("<u2").tobytes(), weights[there], sums[there])

        for batch in batches:
            for part, kind, chunk, places, w, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (part, kind > 0, chunk):
                    if at is not None:
                        yield out()
                    at = (part, kind > 0, chunk)
                    weights, sums = (np.zeros(1), 0.0) if kind == FIRST else (np.zeros(PACK, np.float32), np.zeros((PACK, width), np.float32))
                if kind == FIRST:
                    weights, sums = weights + np.frombuffer(w, "<f8"), sums + np.frombuffer(numbers, "<f8")
                else:
                    there, w = np.frombuffer(places, "<u2"), np.frombuffer(w, "<f4")
                    new = np.frombuffer(numbers, "<f2" if kind == TRAINED else "<f4").reshape(-1, width)
                    weights[there] += w
                    sums[there] += new.astype(np.float32) * w[:, None] if kind == TRAINED else new
        if at is not None:
            yield out()

    return run


def train(spark: SparkSession, texts: DataFrame, words: Words, n_tokens: int, n_texts: int) -> dict[str, np.ndarray]:
    """Parameters from all rows of the column text (binary): a pass over every partition, averaged."""
    shared = spark.sparkContext.broadcast(words)
    start = Trainer(fresh_model(words), words, 3)
    if not n_texts:
        return start.m
    short = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= START_BYTES)
    first = [r[0] for r in common.bounded_sample(short, START_TEXTS, "text", total=n_texts).collect()]
    for _ in range(3):
        for read in words.read(first):
            start.steps(read.flat, read.real, read.place, MINIBATCH // 4)
    at = np.flatnonzero((start.past["S"] != np.float32(INNER_FLOOR)).any(axis=1))
    first_level = lambda x: {k: x[k] for k in LEVEL_ONE}
    begun = spark.sparkContext.broadcast((first_level(start.m), first_level(start.past), at, start.m["S"][at], start.past["S"][at]))
    del start.past

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, held, size = None, None, [], 0

        def learn(whole: bool) -> None:
            """Steps of whole minibatches; the tokens left over wait for more, with the two before them."""
            nonlocal own, first, held, size
            if own is None:
                own = _started(shared.value, begun.value)
                first = own.m["S"].copy()
            begin = np.cumsum([0, *(len(x[0]) for x in held)])
            flat, real = np.concatenate([x[0] for x in held]), np.concatenate([x[1] + b for x, b in zip(held, begin)])
            place, to = np.concatenate([x[2] for x in held]), size if whole else size // MINIBATCH * MINIBATCH
            own.steps(flat, real[:to], place[:to], MINIBATCH)
            size -= to
            held = [(flat[real[to] - 2 :], real[to:] - real[to] + 2, place[to:])] if size else []

        for batch in batches:
            for read in shared.value.read(batch.column(0).to_pylist()):
                held.append((read.flat, read.real, read.place))
                size += len(read.real)
                if size >= 4 * MINIBATCH:
                    learn(False)
        if size:
            learn(True)
        if own is not None:
            yield from _packed(own, first)

    trainers = texts.rdd.getNumPartitions()
    fewer = max(1, min(trainers, n_tokens // TRAINER_TOKENS))
    rows = (texts.coalesce(fewer) if fewer < trainers else texts).mapInArrow(run, PACKED)
    # Added in two steps, so that no task adds up more than about the square root of the number of trainers.
    groups = max(1, int(np.sqrt(fewer)))
    width = start.m["S"].shape[1]
    for part in (F.col("part") % groups, F.lit(0)):
        keyed = rows.withColumn("part", part.cast("int")).withColumn("level", F.col("kind") > 0)
        order = ("part", "level", "chunk")
        rows = keyed.repartition(common.shuffle_width(spark), *order).sortWithinPartitions(*order).drop("level").mapInArrow(_added(width), PACKED)
    flat = np.concatenate([start.m[k].ravel() for k in LEVEL_ONE])
    out = {"S": start.m["S"]}
    for batch in rows.toArrow().to_batches():  # the model, once
        for kind, chunk, places, weights, numbers in zip(*(batch.column(k) for k in ("kind", "chunk", "places", "weights", "numbers"))):
            lo = chunk.as_py() * PACK
            if kind.as_py() == FIRST:
                numbers = np.frombuffer(numbers.as_py(), "<f8")
                flat[lo : lo + len(numbers)] = numbers / np.frombuffer(weights.as_py(), "<f8")[0]
            else:
                at = lo + np.frombuffer(places.as_py(), "<u2").astype(np.int64)
                out["S"][at] += np.frombuffer(numbers.as_py(), "<f4").reshape(-1, width) / np.frombuffer(weights.as_py(), "<f4")[:, None]
    lo = 0
    for k in LEVEL_ONE:
        out[k] = flat[lo : lo + start.m[k].size].reshape(start.m[k].shape)
        lo += start.m[k].size
    return out


def model_counts(counts: DataFrame, n_words: int) -> list[tuple[bytes, int]]:
    """The n_words most frequent words and END with their counts, the most frequent first."""
    # Whole levels of counts, 16 a power of two, as far as there is room; of the next one those with the smallest hashes.
    # No partition sends more than its share of the words asked for.
    level, words = F.floor(F.log2("c") * 16), counts.where(F.col("word") != F.lit(END))
    room, least, partly = n_words, None, None
    for row in words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        if row["n"] > room:
            partly = row["level"]
            break
        room, least = room - row["n"], row["level"]
    parts = [counts.where(F.col("word") == F.lit(END))]
    if least is not None:
        parts.append(words.where(level >= least))
    if partly is not None and room:
        parts.append(common.bounded_sample(words.where(level == partly), room, "word"))
    found = [x for part in parts for x in zip(*(c.to_pylist() for c in part.select("word", "c").toArrow().columns))]
    return sorted(found, key=lambda r: (-r[1], r[0]))


@dataclass
class Learned:
    """What is learned from the training texts: the table of counts (word, class, c), N, V, the model's words and its parameters."""

    counts: DataFrame
    n: int
    v: int
    words: Words
    model: dict[str, np.ndarray]


def learn(training: DataFrame) -> Learned:
    """Counts and model of all rows of the column text (binary)."""
    counts = common.materialize(word_counts(training), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    listed = model_counts(counts, MODEL_WORDS)
    by_class = counts.where(F.col("word") != F.lit(END)).groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    words = Words(listed or [(END, 0)], {r["class"]: (r["c"], r["v"]) for r in by_class})  # no training text: the end is still an output
    return Learned(counts, int(totals["n"]), int(totals["v"]), words, train(training.sparkSession, training, words, int(totals["n"]), dict(listed).get(END, 0)))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), (common.fold_of(F.col(id_col)) == held_out_fold).alias("held_out"))
    training = src.where("not held_out").select("text")
    learned = learn(training)
    counts, n = learned.counts, learned.n
    log_base = float(np.log10(n + 0.5 * (learned.v + 1)))
    shared = spark.sparkContext.broadcast((learned.words, tables(learned.model, learned.words)))  # a fixed number of words and outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made = shared.value
        end = own.end  # the number of the end
        for batch in batches:
            rows = []
            for read in own.read(batch.column(1).to_pylist()):
                scores = log_probabilities(own, made, read) / np.log(10)
                text = np.repeat(np.arange(read.to - read.at), np.diff(read.upto))
                known = read.number >= 0
                n_known = np.bincount(text, own.known[read.number] & known, read.to - read.at).astype(np.int64) + int(own.known[end])
                log_known = np.bincount(text, np.where(known, own.log_count[read.number], 0.0), read.to - read.at) + own.log_count[end]
                beyond = np.flatnonzero(~known)
                scores -= np.bincount(text[beyond], own.log_rest[read.kind[beyond]], read.to - read.at)
                cuts = np.searchsorted(beyond, read.upto).tolist()
                left = [key_of(read.data[a:b]) for a, b in zip(read.starts[beyond].tolist(), read.ends[beyond].tolist())]
                for k, (n, c, logs, score) in enumerate(zip((np.diff(read.upto) + 1).tolist(), n_known.tolist(), log_known.tolist(), scores.tolist())):
                    rare = Counter(left[cuts[k] : cuts[k + 1]])
                    rows.append((n, c, logs, score, list(rare), list(rare.values())))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2), batch.column(3)], ["doc_id", "n_tokens", "known", "log_known", "model", "rare", "times", "held_out", "row"])

    shape = "doc_id long, n_tokens long, known long, log_known double, model double, rare array<binary>, times array<int>, held_out boolean, row long"
    first = common.materialize(src.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("row")).mapInArrow(run, shape), "scores")
    # Words beyond the model's: their counts are joined by word. None has more than a MODEL_WORDS-th of all tokens, but
    # for those of one level of counts that the model has no room for; Spark splits a key that is large for the join.
    spread = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    joined = spread.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_rare"), F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("times"))), F.lit(0)).alias("known_rare"))
    out = first.select("row", "doc_id", "held_out", "n_tokens", "known", "log_known", "model").join(joined, "row", "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_known") + log_rare - F.col("n_tokens") * F.lit(log_base)).alias("base_score"),
        (F.col("model") + log_rare).alias("score"),
    )


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(common.table(spark, sf_dir, "documents"))
