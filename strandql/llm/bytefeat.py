"""Vectorised words, hashes and n-grams over the concatenated bytes of many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
#: Bytes handled at once; a longer text is handled alone.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Any ASCII character but letters and digits ends a normalised word.
_OTHER = np.ones(256, bool)
_OTHER[48:58] = _OTHER[65:91] = _OTHER[97:123] = False
_OTHER[128:] = False

#: First bytes of the characters of scripts that write no spaces (Han, kana, Thai, Lao, Khmer, Burmese, CJK beyond U+FFFF):
#: by the first byte alone, or by the first two.
_ALONE = np.zeros(256, bool)
_ALONE[0xE3:0xEA] = True
_ALONE_TWO = np.zeros(1 << 16, bool)
_ALONE_TWO[[0xE0B8, 0xE0B9, 0xE0BA, 0xE0BB, 0xE180, 0xE181, 0xE182, 0xE19E, 0xE19F, 0xF0A0, 0xF0A1, 0xF0A2, 0xF0A3, 0xF0A4, 0xF0A5, 0xF0A6, 0xF0A7, 0xF0A8, 0xF0A9, 0xF0AA, 0xF0AB, 0xF0AC, 0xF0AD, 0xF0AE, 0xF0AF, 0xF0B0, 0xF0B1, 0xF0B2]] = True
#: The leading bytes of a number of eight, by how many of them belong to a span.
_LEADING = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer spans are hashed one by one.
LONG_SPAN = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[bytes | None], limit: int = CHUNK, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, one past the last, their bytes each followed by a newline, offsets of the texts); null is empty. lower: A-Z as a-z."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or b"") + 1 <= limit):
            size += len(texts[to] or b"") + 1
            to += 1
        own = [t or b"" for t in texts[at:to]]
        offsets = np.cumsum([0, *(len(t) + 1 for t in own)])
        whole = b"\n".join([*own, b""])
        yield at, to, np.frombuffer(whole.lower() if lower else whole, np.uint8), offsets
        at = to


def spans(buf: np.ndarray, normalised: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words. normalised: only letters, digits and non-ASCII bytes belong to words."""
    gap = (_OTHER if normalised else _SPACE)[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    return edge[0::2], edge[1::2]


def single_characters(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same words, with each character of a script that writes no spaces a word of its own."""
    lead = buf >= 0xE0
    if not lead.any():
        return starts, ends
    at = np.flatnonzero(lead[:-1])
    at = at[_ALONE[buf[at]] | _ALONE_TWO[buf[at].astype(np.int64) << 8 | buf[at + 1]]]
    if not len(at):
        return starts, ends
    own = np.searchsorted(starts, at, "right") - 1
    to = np.minimum(at + np.where(buf[at] >= 0xF0, 4, 3), ends[own])
    inner = to < ends[own]
    starts = np.unique(np.concatenate([starts, at, to[inner]]))
    closes = np.unique(np.concatenate([ends, to, at]))
    return starts, closes[np.searchsorted(closes, starts, "right")]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands; spans of up to eight bytes never share one."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    size = ends - starts
    out = mix((size.astype(np.uint64) + np.uint64(1)) * _P)
    out = mix(out ^ (eight[starts] & _LEADING[np.minimum(size, 8)]) * _P)
    left, done = np.flatnonzero(size > 8), 8
    while len(left) and done < LONG_SPAN:
        lane = eight[starts[left] + done] & _LEADING[np.minimum(size[left] - done, 8)]
        out[left] = mix(out[left] ^ lane * _P)
        done += 8
        left = left[size[left] > done]
    if len(left):
        import xxhash

        for k in left.tolist():
            out[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]].tobytes(), 9)
    return out


#: Up to so many bytes three numbers of eight bytes hold a span whole.
THREE_NUMBERS = 24
_LONG = np.uint64(1 << 63)


def padded(buf: np.ndarray) -> np.ndarray:
    """The bytes with eight more behind them, which span_keys reads beyond."""
    return np.concatenate([buf, np.zeros(8, np.uint8)])


def span_keys(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """(a key of each span, the spans of more than seven bytes, their first, second and last eight bytes and sizes); buf is padded.

    Two spans of up to seven bytes have one key only if they are equal; two of up to THREE_NUMBERS are equal if their
    numbers and sizes are.
    """
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    size = hi - lo
    keys = eight[lo] & _LEADING[np.minimum(size, 8)]
    long = np.flatnonzero(size > 7)
    own = size[long].astype(np.uint64)
    first, middle, last = keys[long], eight[np.minimum(lo[long] + 8, hi[long] - 8)], eight[hi[long] - 8]
    keys |= size.astype(np.uint64) << np.uint64(56)
    keys[long] = mix(first * _P ^ mix(middle * _P ^ mix(last + own))) | _LONG
    return keys, long, (first, middle, last, own)


class SpanTable:
    """The numbers of known words, found by their bytes: an open hash table whose hits are compared, a dictionary for long words."""

    def __init__(self, words: list[bytes]) -> None:
        self.n = len(words)
        self.bits = max(10, int(4 * self.n).bit_length())
        self.slots = np.zeros(1 << self.bits, np.int32)  # a word's number and one; 0 is empty
        whole = padded(np.frombuffer(b"".join(words), np.uint8))
        ends = np.cumsum([len(w) for w in words]) if words else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if words else ends
        # At least one word more than there are: place 0 of keys and parts is the empty slot's.
        self.keys, self.parts = np.zeros(self.n + 1, np.uint64), np.zeros((4, self.n + 1), np.uint64)
        if not words:
            self.odd: dict[bytes, int] = {}
            return
        keys, long, parts = span_keys(whole, starts, ends)
        self.keys[1:] = keys
        for row, part in enumerate(parts):
            self.parts[row, long + 1] = part
        _, first = np.unique(keys, return_index=True)
        seated = first[ends[first] - starts[first] <= THREE_NUMBERS]
        rest = np.ones(self.n, bool)
        rest[seated] = False
        self.odd = {words[k]: k for k in np.flatnonzero(rest).tolist()}
        entries = (seated + 1).astype(np.int32)
        slot = self._slot(self.keys[entries])
        while len(entries):
            empty = self.slots[slot] == 0
            self.slots[slot[empty]] = entries[empty]
            left = self.slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _P) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, buf: np.ndarray, data: bytes, lo: np.ndarray, hi: np.ndarray, named=None) -> np.ndarray:
        """The number of each span's word, -1 where it is none; buf is padded. named(bytes): the word that stands for a long one."""
        keys, long, parts = span_keys(buf, lo, hi)
        slot = self._slot(keys)
        at = self.slots[slot]
        todo = np.flatnonzero((at > 0) & (self.keys[at] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            at[todo] = self.slots[slot[todo]]
            todo = todo[(at[todo] > 0) & (self.keys[at[todo]] != keys[todo])]
        out = at.astype(np.int64) - 1
        differ = parts[3] > THREE_NUMBERS
        for row, part in enumerate(parts):
            differ |= (at[long] > 0) & (self.parts[row, at[long]] != part)
        for k in long[differ].tolist():
            word = data[lo[k] : hi[k]]
            out[k] = self.odd.get(named(word) if named else word, -1)
        return out


def characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of every character and the end, a number for each character: its bytes)."""
    inner = (buf & 0xC0) == 0x80
    if not inner.any():
        return np.arange(len(buf) + 1), buf.astype(np.uint64)
    starts = np.append(np.flatnonzero(~inner), len(buf))
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    return starts, eight[starts[:-1]] & _LEADING[np.minimum(np.diff(starts), 4)]


def inner_grams(buf: np.ndarray, size: int, chars: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, one past the last, hash) of the n-grams of so many characters that have white space at their ends only."""
    starts, value = characters(buf) if chars is None else chars
    n = len(value) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gap = _SPACE[buf[starts[:-1]]]
    value = np.where(gap, np.uint64(32), value)
    bad = np.zeros(n, bool)
    for k in range(1, size - 1):
        bad |= gap[k : k + n]
    at = np.flatnonzero(~bad)
    key = np.full(len(at), size, np.uint64)
    for k in range(size):
        key = key * _P + value[at + k]
    return starts[at], starts[at + size], mix(key)
