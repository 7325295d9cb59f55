import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandql.llm import huffman

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
WORDS = huffman.WordIds(TOKENIZER, "<u2")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=400))
def test_lengths_are_a_full_limited_code(counts):
    counts = np.array(counts)
    n = int((counts > 0).sum())
    lengths = huffman.code_lengths(counts, 10)
    used = lengths[counts > 0].astype(float)
    assert (lengths[counts == 0] == 0).all()
    if n > 1:
        assert used.max() <= 10 and np.isclose((2.0**-used).sum(), 1.0)


def test_lengths_are_optimal_where_the_limit_is_wide():
    import heapq

    counts = np.random.default_rng(3).integers(1, 5000, 300)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((huffman.code_lengths(counts, 24) * counts).sum()) == cost


def test_codes_are_canonical_and_prefix_free():
    counts = np.random.default_rng(4).integers(0, 100, 200)
    lengths = huffman.code_lengths(counts, 12)
    codes = huffman.canonical_codes(lengths)
    words = sorted(f"{int(c):0{n}b}" for c, n in zip(codes, lengths) if n)
    assert not any(b.startswith(a) for a, b in zip(words, words[1:]))
    order = sorted((n, s) for s, n in enumerate(lengths) if n)
    assert [codes[s] << (12 - n) for n, s in order] == sorted(codes[s] << (12 - n) for n, s in order)


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 65_536, 65_537, 200_000])
def test_file_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 49_000).astype("<u2")
    lengths = huffman.code_lengths(np.bincount(ids, minlength=49_408))
    cut = n // 3
    data = huffman.file_bytes([None, 5, -7], np.array([cut, 0, n - cut]), ids, lengths, huffman.canonical_codes(lengths))
    ((docs, sizes, back),) = huffman.read_file(data)
    assert docs == [None, 5, -7] and sizes.tolist() == [cut, 0, n - cut] and (back == ids).all()
    assert len(data) < 3 * n + 60_000


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aB é.!'’s<|>\n\t«»…×÷ſKßĲ̸́²½漢🎉"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_word_ids_are_the_librarys(text):
    got = np.frombuffer(WORDS.encode([text.encode()])[0], "<u2").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["it's THE!! don't'' <|endoftext|>x <|ENDOFTEXT|>", "É. «oui», K̸ ≮ İx ǅ ﬁ", "a\x1fb c\x85d 　z \x00"])
def test_word_ids_of_odd_texts(text):
    assert np.frombuffer(WORDS.encode([text.encode()])[0], "<u2").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "  Two  spaces, and a\nline."
    assert np.frombuffer(huffman.WordIds(other, "<u2").encode([text.encode()])[0], "<u2").tolist() == other.encode(text, add_special_tokens=False).ids


def test_a_small_store_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(huffman, "CACHE_WORDS", 3)
    words = huffman.WordIds(TOKENIZER, "<u2")
    for text in ("one two three four", "five six", "one seven"):
        assert np.frombuffer(words.encode([text.encode()])[0], "<u2").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def expected(rows):
    at, out = 0, []
    for doc, text in rows:
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query(spark, sample):
    rows = sorted((r["doc_id"], r["text"]) for r in sample("documents").collect())
    found = huffman.op10_huffman_ids(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, found)) == expected(rows)


def test_odd_rows(spark, make_docs):
    docs = make_docs((4, "b"), (4, "b"), (2, None), (3, ""), (None, "first"), (9, "long " * 30_000)).withColumnRenamed("n_chars", "ids")
    found = sorted(map(tuple, huffman.encode_documents(spark, docs).collect()), key=lambda r: r[1])
    assert found == expected([(None, "first"), (2, None), (3, ""), (4, "b"), (4, "b"), (9, "long " * 30_000)])
    assert huffman.encode_documents(spark, docs.limit(0)).count() == 0


def test_ids_come_back(spark, make_docs, tmp_path):
    made = huffman.write_ids(spark, make_docs((1, "Some words, some more.")), f"file://{tmp_path}", PATH)
    assert huffman.read_ids(spark, made, with_ids=True).first()["ids"] == [*TOKENIZER.encode("Some words, some more.", add_special_tokens=False).ids, 1]
    assert [p.suffix for p in tmp_path.iterdir() if p.suffix != ".crc"] == [".huf"]


def test_words_of_equal_hashes_keep_their_own_ids(monkeypatch):
    """Thue-Morse words and their complements have equal sums of bytes times powers modulo 2^64, however odd the base."""
    bits = [k.bit_count() & 1 for k in range(1024)]
    a, b = ("".join(pair[x] for x in bits) for pair in ("ab", "ba"))
    monkeypatch.setattr(huffman.bytefeat, "mix", lambda x: x * np.uint64(0))  # every part of 8 to 24 bytes collides
    words = huffman.WordIds(TOKENIZER, "<u2")
    text = f"{a} {b} understanding misunderstood extraordinary, a {b}! understandings {a} " + " ".join(f"sometimes{k:04d}" for k in range(300))
    for _ in range(2):
        assert np.frombuffer(words.encode([text.encode()])[0], "<u2").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_copies_of_one_row_spread_over_ranges(spark, make_docs):
    docs = make_docs(*[(7, "the same text again")] * 500, (3, "before"), (9, "behind"))
    made = huffman.write_ids(spark, docs, huffman.common.fresh_path(spark, "copies"), PATH)
    assert made.files.count() > 1
    found = sorted(map(tuple, huffman.read_ids(spark, made).collect()), key=lambda r: r[1])
    assert found == expected([(3, "before"), *[(7, "the same text again")] * 500, (9, "behind")])


def test_span_table_tells_words_by_their_bytes(monkeypatch):
    words = [b"a", b"ab", b"abcdefg", b"abcdefgh", b"abcdefghi", b"x" * 24, b"x" * 25, b"y" * 300, b"\n", "größe".encode()] + [b"word%d" % k for k in range(3000)]
    text = b" ".join([*words[:8], *words[9:], b"none", b"abcdefgz", b"x" * 26, b"y" * 299, b"word3000"])
    for flat in (False, True):
        if flat:
            monkeypatch.setattr(huffman.bytefeat, "mix", lambda x: x * np.uint64(0))  # all spans of 8 to 24 bytes collide
        table = huffman.bytefeat.SpanTable(words)
        buf = np.frombuffer(text, np.uint8)
        starts, ends = huffman.bytefeat.spans(buf, False)
        found = table.find(huffman.bytefeat.padded(buf), text, starts, ends).tolist()
        assert found == [*range(8), *range(9, len(words)), -1, -1, -1, -1, -1]
    empty = huffman.bytefeat.SpanTable([])
    assert empty.find(huffman.bytefeat.padded(buf), text, starts, ends).max() == -1
