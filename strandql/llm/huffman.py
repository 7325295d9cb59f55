"""Token ids in files: canonical length-limited Huffman codes, independent blocks, bit-offset checkpoints.

``write_ids`` encodes every text with a public tokenizer, counts the ids of the whole corpus, builds one
canonical code whose words have at most ``max_len`` bits (package-merge), and writes the ids in ascending id
order to binary files. ``read_ids`` decodes them with one table look-up per id, every checkpointed segment of
a file advancing in step. Texts are encoded where they are read; their ids are then split by ranges of the document
id, so no task depends on a hot key or on the corpus size; only counts by vocabulary entry and sums by partition reach
the driver. The folder must be on a store that pyarrow can write (local or mounted, HDFS, S3, GCS).

Defined cases: a null or empty text has the end id alone; a very long one is encoded whole and lies in one file; repeated rows are encoded as often as they occur
(equal ids are ordered by their text's hash); a null id sorts first and comes back null; an empty table gives
no files and an empty result; other columns are not read.

File layout, little-endian: magic (8 bytes); n_docs, n_blocks, ids per block, ids per checkpoint, crc32 of the
code lengths, size of the packed code lengths (6 x u32); n_ids (u64); code lengths (zlib); doc ids (i64 each);
null flags (u8 each); ids per document (u32 each); payload offset of every block and the end (u64 each); bit
offset of every checkpoint within its block (u32 each); payload. Each block starts at a byte boundary, bits
run from high to low.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandql.llm import bytefeat, common

MAGIC = b"STRHUF01"
HEAD = struct.Struct("<8s6IQ")
BLOCK_IDS = 1 << 16
CHECKPOINT_IDS = 256
#: A file is closed when it holds so many ids.
FILE_IDS = 1 << 23
#: Words whose ids a Python worker remembers; the memory of a worker is bounded by it.
CACHE_WORDS = 2_000_000


# ---- code


def code_lengths(counts: np.ndarray, max_len: int = 18) -> np.ndarray:
    """Optimal code lengths under the limit (package-merge); 0 for symbols that do not occur. counts: int64 by symbol."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    limit = max(max_len, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, leaf_flags = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        level = both[place]
        leaf_flags.append(place < n)
    lengths = np.zeros(n, np.uint8)
    take = 2 * n - 2
    for flags in reversed(leaf_flags):
        chosen = int(flags[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words by symbol: ascending by length, then by symbol."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        top = int(lengths.max())
        room = np.uint64(1) << (np.uint64(top) - lengths[order].astype(np.uint64))
        first = np.concatenate([[np.uint64(0)], np.cumsum(room)[:-1].astype(np.uint64)])
        codes[order] = first >> (np.uint64(top) - lengths[order].astype(np.uint64))
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(symbol * 32 + length for every string of the longest code's bits, that number of bits)."""
    top = int(lengths.max()) if len(lengths) else 0
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    packed = np.repeat((order * 32 + lengths[order]).astype(np.int64), 1 << (top - lengths[order].astype(np.int64)))
    full = np.zeros(1 << top, np.int64)
    full[: len(packed)] = packed
    return full, top


def pack_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The block's bits and the bit offsets of its checkpoints."""
    size = lengths[ids].astype(np.int64)
    code = codes[ids]
    ends = np.cumsum(size)
    begin = ends - size
    word, high = begin >> 6, (begin & 63) + size
    over = high > 64
    parts = np.where(over, code >> np.maximum(high - 64, 0).astype(np.uint64), code << np.maximum(64 - high, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(parts, first)
    out[word[over] + 1] |= code[over] << (128 - high[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], begin[::CHECKPOINT_IDS].astype("<u4")


def unpack(payload: bytes, at_bit: np.ndarray, n_ids: np.ndarray, full: np.ndarray, top: int) -> np.ndarray:
    """Ids of the segments that begin at these bits, one table look-up an id; the segments advance together."""
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    windows = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    steps = int(n_ids.max()) if len(n_ids) else 0
    out = np.zeros((len(n_ids), steps), np.uint32)
    at = at_bit.astype(np.int64).copy()
    last = (len(windows) - 1) * 8
    for k in range(steps):
        shift = (32 - top - (at & 7)).astype(np.uint32)
        found = full[(windows[at >> 3] >> shift) & np.uint32((1 << top) - 1)]
        out[:, k] = found >> 5
        at = np.minimum(at + (found & 31), last)
    return out[np.arange(steps)[None, :] < n_ids[:, None]]


# ---- one file


def file_bytes(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    blocks, marks, offsets = [], [], [0]
    for k in range(0, len(ids), BLOCK_IDS):
        bits, mark = pack_block(ids[k : k + BLOCK_IDS], lengths, codes)
        blocks.append(bits)
        marks.append(mark)
        offsets.append(offsets[-1] + len(bits))
    packed = zlib.compress(lengths.tobytes(), 6)
    head = HEAD.pack(MAGIC, len(doc_ids), len(blocks), BLOCK_IDS, CHECKPOINT_IDS, zlib.crc32(lengths.tobytes()), len(packed), len(ids))
    return b"".join(
        [
            head,
            packed,
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            sizes.astype("<u4").tobytes(),
            np.array(offsets, "<u8").tobytes(),
            *(m.tobytes() for m in marks),
            *blocks,
        ]
    )


def read_file(data: bytes, group: int = 32) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, ids per document, all ids) of a file; blocks are decoded so many at a time."""
    magic, n_docs, n_blocks, per_block, per_mark, crc, packed, n_ids = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    at = HEAD.size
    lengths = np.frombuffer(zlib.decompress(data[at : at + packed]), np.uint8)
    if zlib.crc32(lengths.tobytes()) != crc:
        raise ValueError("the code lengths are damaged")
    at += packed
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    nulls = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    sizes = np.frombuffer(data, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 13 * n_docs
    offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
    at += 8 * (n_blocks + 1)
    in_block = np.minimum(per_block, n_ids - per_block * np.arange(n_blocks, dtype=np.int64))
    in_marks = -(-in_block // per_mark)
    marks = np.frombuffer(data, "<u4", int(in_marks.sum()), at).astype(np.int64)
    at += 4 * len(marks)
    first = np.concatenate([[0], np.cumsum(in_marks)])
    full, top = decode_table(lengths)
    ids = []
    for k in range(0, n_blocks, group):
        to = min(k + group, n_blocks)
        base = np.repeat((offsets[k:to] - offsets[k]) * 8, in_marks[k:to])
        own = np.concatenate([np.minimum(per_mark, in_block[j] - per_mark * np.arange(in_marks[j])) for j in range(k, to)])
        ids.append(unpack(data[at + offsets[k] : at + offsets[to]], base + marks[first[k] : first[to]], own, full, top))
    yield [None if z else int(d) for d, z in zip(doc_ids, nulls)], sizes, np.concatenate(ids) if ids else np.zeros(0, np.uint32)


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder's URI, by the default file system of Spark where the folder names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _store(uri: str):
    """pyarrow file system and path of a folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else f"file://{uri.removeprefix('file:')}")


def joined(column: pa.Array) -> memoryview | bytes:
    """The bytes of all rows of a binary column without nulls, one behind the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2])[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] else b""


# ---- tokenizing

#: By path and kind of number, for the life of a Python worker.
_encoders: dict[tuple[str, str], WordIds] = {}


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:127] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_PUNCTUATION &= ~_ALNUM
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def core_ends(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the ASCII punctuation at the end of each word begins, if a letter or digit stands before it; else the end.

    Letters outside ASCII are known by their first byte: U+00C0 to U+027F are letters but for the signs of
    multiplication and division.
    """
    out = ends.copy()
    own = np.flatnonzero(_PUNCTUATION[buf[ends - 1]])
    tip, least = ends[own] - 1, starts[own]  # the last byte that may be a letter's
    todo = np.arange(len(own))
    while len(todo):
        todo = todo[(tip[todo] > least[todo]) & _PUNCTUATION[buf[tip[todo]]]]
        tip[todo] -= 1
    last, before = buf[tip], buf[np.maximum(tip - 1, 0)]
    letter = (before >= 0xC3) & (before <= 0xC9) & ~((before == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    cut = _ALNUM[last] | ((last >= 0x80) & (tip > least) & letter)
    out[own[cut]] = tip[cut] + 1
    return out


class WordIds:
    """Ids of texts as little-endian numbers, word by word, the parts of words remembered.

    For tokenizers that drop white space and mark the end of a word: their patterns never match across ASCII white
    space, so a text's ids are those of its words. Nor do they match across the border of a letter or digit and
    punctuation that runs to the word's end, so these two parts are looked up apart, and fewer different ones are met.
    Parts of letters only are encoded many in one string: the last token of each, and no other, is one that ends a
    word. Texts that may hold a special token, and all texts of other tokenizers, are encoded as they are.

    A part of seven bytes or fewer is its own key in an open hash table. One of up to bytefeat.THREE_NUMBERS bytes is found by
    a hash of its three numbers of eight bytes and its size, and these are compared at every hit; where they differ, and for longer
    parts, a dictionary of the bytes decides. So no part ever gets another's ids, whatever its hash.
    """

    def __init__(self, tokenizer, kind: str) -> None:
        self.tokenizer, self.kind = tokenizer, kind
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Entry 0 stands for an empty slot."""
        self.n, self.bits = 1, 16
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.keys, self.words = np.zeros(1 << 15, np.uint64), np.zeros((4, 1 << 15), np.uint64)
        self.begins, self.sizes = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        self.flat, self.held = np.zeros(1 << 16, self.kind), 0
        self.by_bytes: dict[bytes, int] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(arrays of ids, where each part begins in them put together, how many ids it has)."""
        ids, held = [], 0
        begins, sizes = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        plain = [k for k, p in enumerate(parts) if p.isalpha()]
        rest = [k for k, p in enumerate(parts) if not p.isalpha()]
        for k in range(0, len(plain), 1000):
            own = plain[k : k + 1000]
            got = self._ids([" ".join([parts[j] for j in own])])[0]
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) != len(own) or cuts[-1] != len(got):
                rest += own
                continue
            sizes[own] = np.diff(cuts, prepend=0)
            begins[own] = held + cuts - sizes[own]
            ids.append(got)
            held += len(got)
        for k in range(0, len(rest), 4096):
            own = rest[k : k + 4096]
            for j, got in zip(own, self._ids([parts[j] for j in own])):
                begins[j], sizes[j] = held, len(got)
                ids.append(got)
                held += len(got)
        return ids, begins, sizes

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, 0 where there is none."""
        slot = self._slot(keys)
        at = self.slots[slot]
        todo = np.flatnonzero((at > 0) & (self.keys[at] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            at[todo] = self.slots[slot[todo]]
            todo = todo[(at[todo] > 0) & (self.keys[at[todo]] != keys[todo])]
        return at

    def _seat(self, entries: np.ndarray) -> None:
        """Give the entries, whose keys are in no slot yet, slots of their own."""
        slot = self._slot(self.keys[entries])
        while len(entries):
            empty = self.slots[slot] == 0
            self.slots[slot[empty]] = entries[empty]
            left = self.slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _add(self, parts: list[bytes]) -> np.ndarray:
        """New entries for these parts, in no slot yet."""
        ids, begins, sizes = self._parts([p.decode("utf-8", "replace") for p in parts])
        to, held = self.n + len(parts), self.held + sum(map(len, ids))
        if to > len(self.keys):
            room = 2 * to
            self.keys, self.begins, self.sizes = (np.resize(x, room) for x in (self.keys, self.begins, self.sizes))
            self.words = np.concatenate([self.words, np.zeros((4, room - self.words.shape[1]), np.uint64)], axis=1)
        if held > len(self.flat):
            self.flat = np.resize(self.flat, 2 * held)
        if ids:
            self.flat[self.held : held] = np.concatenate(ids)
        entries = np.arange(self.n, to, dtype=np.int32)
        self.begins[entries], self.sizes[entries] = begins + self.held, sizes
        self.n, self.held = to, held
        if 2 * to > len(self.slots):
            seated = self.slots[self.slots > 0]
            self.bits += max(1, int(2 * to).bit_length() - self.bits)
            self.slots = np.zeros(1 << self.bits, np.int32)
            self._seat(seated)
        return entries

    def _entries(self, buf: np.ndarray, data: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The entries of the parts from lo to hi; buf is padded."""
        keys, long, whole = bytefeat.span_keys(buf, lo, hi)
        size = hi - lo
        at = self._find(keys)
        missing = np.flatnonzero(at == 0)
        if len(missing):
            new, first_at = np.unique(keys[missing], return_index=True)
            own = missing[first_at]
            entries = self._add([data[lo[k] : hi[k]] for k in own.tolist()])
            self.keys[entries] = new
            place = np.searchsorted(long, own)
            is_long = size[own] > 7
            for row, part in enumerate(whole):
                self.words[row, entries[is_long]] = part[place[is_long]]
            self._seat(entries)
            at[missing] = entries[np.searchsorted(new, keys[missing])]
        got = at[long]
        differ = size[long] > bytefeat.THREE_NUMBERS
        for row, part in enumerate(whole):
            differ |= self.words[row, got] != part
        odd = long[differ]
        if len(odd):
            parts = [data[lo[k] : hi[k]] for k in odd.tolist()]
            fresh = list(dict.fromkeys(p for p in parts if p not in self.by_bytes))
            self.by_bytes.update(zip(fresh, self._add(fresh).tolist()))
            at[odd] = [self.by_bytes[p] for p in parts]
        return at

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        by_word = self.ends.any()
        whole = [k for k, t in enumerate(texts) if t and (not by_word or b"<|" in t)]
        out = [b""] * len(texts)
        for k in range(0, len(whole), 64):
            own = whole[k : k + 64]
            for j, ids in zip(own, self._ids([texts[j].decode("utf-8", "replace") for j in own])):
                out[j] = ids.tobytes()
        taken = set(whole)
        # These tokenizers lower-case anyhow.
        for at, to, buf, offsets in bytefeat.chunks([t.lower() if t and k not in taken else b"" for k, t in enumerate(texts)]):
            starts, ends = bytefeat.spans(buf, False)
            if not len(starts):
                continue
            if self.n > CACHE_WORDS:
                self._forget()
            cuts = core_ends(buf, starts, ends)
            tail = cuts < ends
            place = np.arange(len(starts)) + np.cumsum(tail) - tail
            lo, hi = np.empty(len(starts) + int(tail.sum()), np.int64), np.empty(len(starts) + int(tail.sum()), np.int64)
            lo[place], hi[place] = starts, cuts
            lo[place[tail] + 1], hi[place[tail] + 1] = cuts[tail], ends[tail]
            data = buf.tobytes()
            known = self._entries(bytefeat.padded(buf), data, lo, hi)
            sizes = self.sizes[known]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.flat[np.arange(upto[-1]) + np.repeat(self.begins[known] - upto[:-1], sizes)]
            edges = upto[np.searchsorted(lo, offsets)].tolist()
            for k in range(to - at):
                if at + k not in taken:
                    out[at + k] = ids[edges[k] : edges[k + 1]].tobytes()
        return out


def _tokenize(path: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if (path, kind) not in _encoders:
            _encoders[path, kind] = WordIds(Tokenizer.from_file(path), kind)
        end = np.array([end_id], kind).tobytes()
        seq = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            ids = [own + end for own in _encoders[path, kind].encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(range(seq, seq + n), pa.int64()), pa.array(ids, pa.large_binary()).cast(pa.binary())], ["doc_id", "tie", "seq", "ids"])
            seq += n

    return run


@dataclass
class IdFiles:
    """Where the files are and the table of them: part, first_seq, n_docs, n_ids, name, base."""

    folder: str
    files: DataFrame


def write_ids(spark: SparkSession, docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int = 1, max_len: int = 18, id_col: str = "doc_id", text_col: str = "text") -> IdFiles:
    """Encode all texts into the folder's files. tokenizer_path must be readable at the same place on every executor."""
    from tokenizers import Tokenizer

    vocab = max(Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values()) + 1
    vocab = max(vocab, end_id + 1)
    kind = "<u2" if vocab <= 1 << 16 else "<u4"
    folder = _qualified(spark, folder)
    common.bounded_batches(spark)
    text = F.col(text_col).cast("binary")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    # Ids are smaller than texts: the texts are encoded where they are read, and only ids are dealt into ranges.
    tokens = common.materialize(src.mapInArrow(_tokenize(tokenizer_path, end_id, kind), "doc_id long, tie long, seq long, ids binary"), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(joined(batch.column(0)), kind), minlength=vocab)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["id", "n"])

    counts = np.zeros(vocab, np.int64)
    for row in tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts, max_len)
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))  # a fixed size: the vocabulary's

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, codes = shared.value
        store, home = _store(folder)
        store.create_dir(home, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        run: list[tuple[int | None, bytes]] = []
        held = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(r[1] for r in run), kind)
            sizes = np.array([len(r[1]) for r in run], np.int64) // np.dtype(kind).itemsize
            name = f"ids-{part:06d}-{seq - len(run):012d}.huf"
            with store.open_output_stream(tmp := f"{home}/_{name}.{uuid.uuid4().hex}") as out:
                out.write(file_bytes([r[0] for r in run], sizes, ids, size, codes))
            store.move(tmp, f"{home}/{name}")  # a repeated task writes the same file again
            return pa.RecordBatch.from_pylist([{"part": part, "first_seq": seq - len(run), "n_docs": len(run), "n_ids": len(ids), "name": name}], pa.schema([("part", pa.int32()), ("first_seq", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("name", pa.string())]))

        for batch in batches:
            for doc, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if held >= FILE_IDS:
                    yield close()
                    run, held = [], 0
                run.append((doc, ids))
                seq += 1
                held += len(ids) // np.dtype(kind).itemsize
        if run:
            yield close()

    # Equal rows need no order among them: seq parts them, so that any number of copies spreads over ranges.
    order = ("doc_id", "tie", "seq")
    ranges = max(common.shuffle_width(spark), int(counts.sum()) // (4 * FILE_IDS))
    ranged = tokens.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    files = common.materialize(ranged.mapInArrow(write, "part int, first_seq long, n_docs long, n_ids long, name string"), "token-files")
    common.discard(tokens)
    by_part = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row a partition
    starts = np.cumsum([0, *(n for _, n in by_part)])
    bases = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(by_part, starts)], "part int, part_base long")
    before = Window.partitionBy("part").orderBy("first_seq").rowsBetween(Window.unboundedPreceding, -1)
    return IdFiles(folder, files.join(F.broadcast(bases), "part").withColumn("base", F.col("part_base") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("part_base"))


def read_ids(spark: SparkSession, made: IdFiles, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids, from the files."""
    folder = made.folder
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, home = _store(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{home}/{name}") as src:
                    data = src.read()
                for docs, sizes, ids in read_file(data):
                    ends = np.cumsum(sizes)
                    wide = ids.astype("<u4")
                    crc = [zlib.crc32(wide[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist())]
                    columns = [pa.array(docs, pa.int64()), pa.array(base + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.array([wide[e - s : e].tolist() for e, s in zip(ends.tolist(), sizes.tolist())], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    listed = made.files.select("name", "base").repartition(common.shuffle_width(spark))
    return listed.mapInArrow(read, shape)


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write the ids of all documents to files in the shared folder and read them back."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return read_ids(spark, write_ids(spark, docs, common.fresh_path(spark, "huffman"), tokenizer_path))


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, common.table(spark, sf_dir, "documents"))
