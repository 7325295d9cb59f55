import random

import numpy as np

from strandql.llm import decontaminate as d

ITEM_SCHEMA = "item_id long, text string"


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def edited(words, k, rng, vocab):
    words = list(words)
    for _ in range(k):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at : at + (kind != 0)] = [rng.choice(vocab)] * (kind != 1)
    return words


def plain_edits(a, b):
    """Least edit distance between a and any window of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_least_edits_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        a = np.array([rng.randint(1, 6) for _ in range(rng.randint(1, 12))], np.uint64)
        b = np.array([rng.randint(1, 6) for _ in range(rng.randint(0, 20))], np.uint64)
        want = plain_edits(a.tolist(), b.tolist())
        for most in (0, 2, 20):
            assert d.least_edits(a, b, most) == min(want, most + 1)


def test_planted_leaks_are_found_and_others_are_not(spark, make_docs):
    rng, vocab = random.Random(3), vocabulary(4000)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab)
    items = [(i, [word() for _ in range(rng.randint(14, 60))]) for i in range(60)]
    docs, planted = [], {}
    for n in range(200):
        body = [word() for _ in range(rng.randint(50, 400))]
        if n < 120:
            i, words = items[n % 60]
            k = rng.randint(0, len(words) // 5)
            at = rng.randrange(len(body))
            body[at:at] = edited(words, k, rng, vocab)
            planted[n] = i
        docs.append((n, " ".join(w.upper() + "%%%" if n % 7 == 0 else w for w in body)))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEM_SCHEMA)
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in d.find_leaks(make_docs(*docs), table).collect()}
    norm = [[w.lower().rstrip("%") for w in t.split()] for _, t in docs]
    truth = {(n, i) for n in range(200) for i, w in items if plain_edits(w, norm[n]) <= int(0.2 * len(w))}
    assert truth >= set(planted.items())
    assert set(found) <= truth and len(found) >= 0.95 * len(truth)
    assert all(v == plain_edits(dict(items)[i], norm[n]) for (n, i), v in found.items())


def test_query_against_brute_force(spark, sample):
    items = [(r["item_id"], r["text"]) for r in sample("benchmark").collect()]
    docs = [(r["doc_id"], r["text"]) for r in sample("documents").collect()]
    words = lambda t: [h for _, hs, _ in d.normal_words([t]) for h in hs.tolist()]
    items, docs = [(i, words(t)) for i, t in items], [(i, words(t)) for i, t in docs]
    truth = {(n, i) for n, b in docs for i, a in items if len(set(a) - set(b)) <= int(0.2 * len(a)) and plain_edits(a, b) <= int(0.2 * len(a))}
    found = {(r["doc_id"], r["item_id"]) for r in d.op7_cgk_decontamination(spark, "/root/testdata/sf0.001").collect()}
    assert found <= truth and len(found) >= 0.9 * len(truth) and truth


def test_short_items_and_odd_rows(spark, make_docs):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "two words"), (3, None), (4, ""), (1, "alpha beta gamma delta epsilon")], ITEM_SCHEMA)
    docs = make_docs((1, "x y Alpha, beta gamma-delta EPSILON z"), (1, "x y Alpha, beta gamma-delta EPSILON z"), (2, "two words"), (3, None), (4, ""), (None, "alpha beta gamma delta epsilon"), (6, "w " * 40_000 + "alpha beta gamma other epsilon")).withColumnRenamed("n_chars", "item_id")
    found = sorted((str(r["doc_id"]), r["item_id"], r["distance"]) for r in d.find_leaks(docs, items).collect())
    assert found == [("1", 1, 0)] * 2 + [("2", 2, 0), ("6", 1, 1), ("None", 1, 0)]
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4]
    assert d.find_leaks(docs, items.limit(0)).count() == 0 and d.drop_contaminated(docs, items.limit(0)).count() == 7
    assert d.find_leaks(docs.limit(0), items).count() == 0


def test_short_items_are_matched_exactly(spark, make_docs):
    items = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "one, two; three"), (4, "a b c d"), (5, "Beta-Gamma!"), (6, "."), (7, "数学の問題を解く"), (8, "คณิต")], ITEM_SCHEMA)
    docs = make_docs((1, "x alpha"), (2, "alphas betas gamma"), (3, "beta"), (4, "gamma beta gamma beta"), (5, "one two"), (6, "three one two three"), (7, "a b c d"), (8, "a b x c d"), (9, "昨日、数学の問題を解くことにした"), (10, "数学の答え"), (11, "วิชาคณิตศาสตร์"))
    found = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in d.find_leaks(docs, items).collect())
    assert found == [(1, 1, 0), (4, 2, 0), (6, 3, 0), (7, 4, 0), (9, 7, 0), (11, 8, 0)]
    assert sorted(r["doc_id"] for r in d.drop_contaminated(docs, items).collect()) == [2, 3, 5, 8, 10]
    assert {r["item_id"]: r["same_as"] for r in d.item_classes(items).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 2, 7: 7, 8: 8}


def test_words_of_scripts_without_spaces():
    words = lambda t: [h for _, hs, _ in d.normal_words([t]) for h in hs.tolist()]
    assert words("ab漢字cd ef") == [w for t in ("ab", "漢", "字", "cd", "ef") for w in words(t)]
    assert words("漢") == words(" 漢.") and len(words("𠀀𠀁x")) == 3 and len(words("größe naïve Ελλάδα")) == 3


def test_different_spans_have_different_hashes():
    from strandql.llm import bytefeat

    bits = [k.bit_count() & 1 for k in range(1024)]
    texts = ["".join(pair[x] for x in bits[:n]) for pair in ("ab", "ba") for n in (4, 8, 16, 64, 255, 1024)]
    hashes = [h for _, hs, _ in d.normal_words(texts) for h in hs.tolist()]
    assert len(set(hashes)) == len(texts)
    buf = np.frombuffer(b"xx%sabcdefghi" % texts[5].encode(), np.uint8)
    assert bytefeat.span_hashes(buf, np.array([2]), np.array([1026]))[0] == hashes[5]


def test_blocks_of_items(spark, make_docs, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_WORDS", 30)
    monkeypatch.setattr(d, "PASS_BLOCKS", 3)
    vocab = vocabulary(300, 8)
    items = [(i, vocab[20 * i : 20 * i + 20]) for i in range(10)]
    docs = make_docs(*[(i, "before " + " ".join(w) + " after") for i, w in items])
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEM_SCHEMA)
    assert sorted((r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, table).collect()) == [(i, i) for i in range(10)]
