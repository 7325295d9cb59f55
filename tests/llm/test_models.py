"""The language model, the classifiers and language identification."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandql.llm import bytefeat, language_id, logbilinear, subword, toxicity

SF = "/root/testdata/sf0.01"


def fold(doc):
    return zlib.crc32(str(doc).encode()) % 5


# ---- words and hashes


def test_spans_and_hashes_do_not_depend_on_the_place():
    texts = [b"ab cd ab", b"", b"  cd!ab\tx\xc3\xa9 ", b"ab"]
    seen = {}
    for at, to, buf, offsets in bytefeat.chunks(texts):
        for normalised in (False, True):
            starts, ends = bytefeat.spans(buf, normalised)
            for s, e, h in zip(starts, ends, bytefeat.span_hashes(buf, starts, ends).tolist()):
                assert seen.setdefault(buf[s:e].tobytes(), h) == h
    assert {b"ab", b"cd", b"cd!ab", b"x\xc3\xa9"} <= set(seen) and len(set(seen.values())) == len(seen)


def test_chunks_hold_every_text():
    texts = [b"x" * n for n in (0, 5, 3_000_000, 1, 0, 900_000, 900_000)]
    assert [t for at, to, _, _ in bytefeat.chunks(texts) for t in texts[at:to]] == texts


# ---- language model


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: r for r in logbilinear.op6_log_bilinear(spark, SF).collect()}
    texts = {r["doc_id"]: logbilinear.tokens(r["text"].encode()) for r in docs.collect()}
    counts = Counter(t for i, own in texts.items() if fold(i) != 1 for t in own)
    n, v = sum(counts.values()), len(counts)
    gain = tokens = 0
    for i, own in texts.items():
        r = found[i]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i) == 1, len(own), sum(counts[t] > 0 for t in own), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        if r["held_out"]:
            gain, tokens = gain + r["score"] - r["base_score"], tokens + len(own)
    assert gain / tokens > 0.05


def plain_score(words, model, counts, text):
    """The model's log10 probability, token by token from the parameters. counts: of all training words, by word."""
    m = {k: v.astype(float) for k, v in model.items()}
    soft = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    total, w2, w1 = 0.0, words.outputs, words.outputs
    for t in map(logbilinear.key_of, logbilinear.tokens(text)):
        kind = logbilinear.class_of_key(t)
        at = words.number.get(t)
        out = words.output[at] if at is not None else words.first_class + kind
        total += soft((m["R"][w1] @ m["C1"] + m["R"][w2] @ m["C2"]) @ m["Q"].T + m["b"])[out]
        if out >= words.first_class:
            lo, hi = words.class_begin[kind], words.class_end[kind]
            inner = soft((m["R"][w1] @ m["C3"]) @ m["S"][lo:hi, :-1].T + m["S"][lo:hi, -1])
            total += inner[(words.place[at] if at is not None else hi - 1) - lo]
            if at is None:
                others = [c for w, c in counts.items() if w not in words.number and logbilinear.class_of_key(w) == kind]
                total += math.log((counts.get(t, 0) + 0.5) / (sum(others) + 0.5 * (len(others) + 1)))
        w2, w1 = w1, out
    return total / math.log(10)


def test_scores_against_brute_force(spark, make_docs, monkeypatch):
    monkeypatch.setattr(logbilinear, "MODEL_WORDS", 60)
    monkeypatch.setattr(logbilinear, "OUTPUTS", logbilinear.CLASSES + 20)
    long = "q" * 90
    docs = make_docs(*[(i, f"the a{i % 23} b{i % 7} {'of' * (i % 3)} c{i * i % 31} rare{i} {long if i % 9 == 0 else ''}") for i in range(120)], (500, None), (501, f"unseen {long}x words the"))
    found = {r["doc_id"]: r["score"] for r in logbilinear.score_texts(docs).collect()}
    training = docs.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) != 1").selectExpr("cast(text as binary) as text")
    learned = logbilinear.learn(training)
    counts = {bytes(r["word"]): r["c"] for r in learned.counts.collect()}
    assert len(learned.words.number) == 61 and 0 < len(learned.words.share) - logbilinear.CLASSES < 60
    for r in docs.collect():
        assert found[r["doc_id"]] == pytest.approx(plain_score(learned.words, learned.model, counts, (r["text"] or "").encode()), rel=1e-3)


def test_words_beyond_the_model_come_by_join(spark, make_docs, monkeypatch):
    docs = make_docs(*[(i, f"the a{i} b{i % 7} the Of {'z' * 70}") for i in range(60)])
    whole = sorted(map(tuple, logbilinear.score_texts(docs).collect()))
    for most in (12, 1):
        monkeypatch.setattr(logbilinear, "MODEL_WORDS", most)
        few = sorted(map(tuple, logbilinear.score_texts(docs).collect()))
        for a, b in zip(whole, few):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])


def test_model_words_where_all_counts_are_equal(spark):
    counts = spark.createDataFrame([(b"w%d" % i, i % 64, 3) for i in range(500)] + [(logbilinear.END, 0, 9)], "word binary, class int, c long")
    found = logbilinear.model_counts(counts, 100)
    assert len(found) == 101 and found[0] == (logbilinear.END, 9) and len(set(found)) == 101


def test_model_probabilities_sum_to_one():
    counts = [(b"w%d" % i, 5000 - i) for i in range(3000)] + [(logbilinear.END, 20)]
    by_class = {}
    for w, c in [*counts[:-1], *[(b"x%d" % i, 1) for i in range(200)]]:
        n, v = by_class.get(logbilinear.class_of_key(w), (0, 0))
        by_class[logbilinear.class_of_key(w)] = (n + c, v + 1)
    words = logbilinear.Words(counts, by_class)
    trainer = logbilinear.Trainer(logbilinear.fresh_model(words), words, 1)
    rng = np.random.default_rng(0)
    places = rng.integers(0, len(words.share), (20, 500))
    for own in places:
        trainer.steps(np.append([words.outputs] * 2, words.first_class + words.inner_class[own]), np.arange(2, 502), own, 200)
    made = logbilinear.tables(trainer.m, words)
    outs = np.arange(words.outputs)
    for w1, w2 in ((0, 0), (5, words.outputs), (words.outputs, words.outputs)):
        assert np.exp(made["Q"][outs] @ (made["one"][w1] + made["two"][w2]) + made["b"][outs] - made["norm"][w1, w2]).sum() == pytest.approx(1, abs=1e-4)
        inner = np.exp(made["S"][:, :-1] @ made["u"][w1] + made["S"][:, -1] - made["inner"][w1, words.inner_class])
        assert np.add.reduceat(inner, words.class_begin) == pytest.approx(1, abs=1e-4)
    # Among a class's other words: those of the training texts and one for all unseen ones.
    for k in range(logbilinear.CLASSES):
        own = [b"x%d" % i for i in range(200) if logbilinear.class_of_key(b"x%d" % i) == k]
        assert sum(1.5 for _ in own) + 0.5 == pytest.approx(10 ** words.log_rest[k])


def test_rows_of_trainers_add_up():
    rng, width, n = np.random.default_rng(4), 3, logbilinear.PACK
    dense, want, weights = np.zeros(5), np.zeros((n, width)), np.zeros(n)
    rows = []
    for trainer in range(4):
        flat, seen = rng.normal(size=5), float(10 + trainer)
        dense += flat * seen
        rows.append(logbilinear._row((0, logbilinear.FIRST, 0), b"", np.array([seen]), flat * seen))
    for trainer in range(4):
        at, times = np.sort(rng.choice(n, 100, replace=False)), rng.integers(1, 50, 100).astype("<f4")
        moved = rng.normal(size=(100, width)).astype("<f2")
        want[at] += moved.astype(float) * times[:, None]
        weights[at] += times
        rows.append(logbilinear._row((0, logbilinear.TRAINED, 0), at.astype("<u2").tobytes(), times, moved))
    once = list(logbilinear._added(width)(iter(rows)))
    for found in (once, list(logbilinear._added(width)(iter(once)))):  # sums of sums are sums
        first, second = ([x[0].as_py() for x in r.columns] for r in found)
        assert first[:3] == [0, logbilinear.FIRST, 0] and np.frombuffer(first[5]) == pytest.approx(dense) and np.frombuffer(first[4])[0] == 46
        at = np.frombuffer(second[3], "<u2")
        assert second[1] == logbilinear.SUMMED and (at == np.flatnonzero(weights)).all()
        assert np.frombuffer(second[4], "<f4") == pytest.approx(weights[at]) and np.frombuffer(second[5], "<f4").reshape(-1, width) == pytest.approx(want[at], abs=1e-2)


def test_language_model_of_odd_rows(spark, make_docs):
    docs = make_docs((1, None), (1, None), (2, ""), (None, "A b"), (3, "x " * 40_000)).withColumnRenamed("n_chars", "score")
    rows = logbilinear.score_texts(docs).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 1, 3, 40_001] and all(math.isfinite(r["score"]) for r in rows)
    assert logbilinear.score_texts(docs.limit(0)).count() == 0
    held = make_docs(*[(i, "some words") for i in range(40) if fold(i) == 1])
    rows = logbilinear.score_texts(held).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == pytest.approx(0, abs=1e-9) for r in rows)


# ---- quality


def test_quality_on_held_out_rows(spark):
    found = {r["doc_id"]: r for r in subword.op5_subword_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(found[x["doc_id"]], x["quality"]) for x in labels if fold(x["doc_id"]) == 0]
    assert all(r["held_out"] == (fold(i) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in found.items())
    assert sum(r["predicted"] == q for r, q in held) >= 0.95 * len(held)


def test_features_do_not_depend_on_neighbours():
    def own(texts):
        out = [Counter() for _ in texts]
        for at, _, buckets, owner in subword.features(texts):
            for b, o in zip(buckets.tolist(), owner.tolist()):
                out[at + o][b] += 1
        return out

    texts = [b"one two two", b"", b"three", b"one two two"]
    together = own(texts)
    assert together[0] == together[3] == own(texts[:1])[0] and together[2] == own(texts[2:3])[0]
    assert together[1] == Counter() and together[0][0] == 1


def test_quality_of_odd_rows(spark, make_docs):
    docs = make_docs((1, None), (1, None), (2, ""), (None, "a b"), (3, "y " * 30_000)).withColumnRenamed("n_chars", "label")
    for rows in ([], [(3, 1), (3, 0), (77, 1), (None, 0), (2, None), (2, 5)]):
        labels = spark.createDataFrame([(d, q, 0) for d, q in rows], "doc_id long, quality int, toxic int")
        found = subword.quality_scores(docs, labels).collect()
        assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)
    assert subword.quality_scores(docs.limit(0), labels).count() == 0


def test_quality_scores_against_brute_force(spark, sample):
    """Words, repeated words and character n-grams told plainly; each hashed by itself."""
    docs, labels = sample("documents"), sample("labels")
    weights, bias = subword.learn(docs, labels)
    bucket = lambda h: int(h) % (subword.BUCKETS - 1) + 1

    def word(w):
        buf = np.frombuffer(w, np.uint8)
        return bucket(bytefeat.span_hashes(buf, np.array([0]), np.array([len(w)]))[0])

    def gram(g):
        ((h,),) = [bytefeat.inner_grams(np.frombuffer(g.encode(), np.uint8), len(g))[2].tolist()]
        return bucket(h)

    found = {r["doc_id"]: r for r in subword.quality_scores(docs, labels).collect()}
    tried = [r for r in docs.collect() if len(r["text"] or "") < 1500][:40]
    assert len(tried) > 20
    for r in tried:
        text = r["text"] or ""
        words = text.encode().split()
        total = [weights[word(w)] for w in words] + [weights[0] for a, b in zip(words, words[1:]) if a == b]
        chars = text + "\n"
        for n in subword.GRAMS:
            grams = [chars[i : i + n] for i in range(len(chars) - n + 1)]
            total += [weights[gram(g)] for g in grams if not any(c in " \t\n\r\x0b\x0c" for c in g[1:-1])]
        z = bias + (sum(total) / len(total) if total else 0.0)
        row = found[r["doc_id"]]
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6) and row["held_out"] == (fold(r["doc_id"]) == 0)


def test_equal_texts_have_equal_scores(spark, make_docs):
    """Ties: whatever the row, its neighbours and its id, a text has one score."""
    texts = [f"some words of text {k % 5} and more {'vile' if k % 5 == 0 else ''}" for k in range(40)]
    docs = make_docs(*enumerate(texts), *[(100 + k, t) for k, t in enumerate(texts)], *enumerate(texts)).repartition(3)
    labels = spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(40)], "doc_id long, quality int, toxic int")
    for score in (lambda: subword.quality_scores(docs, labels), lambda: toxicity.toxicity_scores(docs, labels), lambda: logbilinear.score_texts(docs)):
        rows = score().collect()
        seen = {}
        for r in rows:
            seen.setdefault(r["doc_id"] % 100 % 5, set()).add(round(r["score"], 9))
        assert len(rows) == 120 and all(len(v) == 1 for v in seen.values())


# ---- toxicity


def test_toxicity_on_planted_words(spark, make_docs):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(900):
        words = [vocab[k] for k in np.minimum(rng.geometric(0.01, 80), 2999)]
        toxic = i % 9 == 0
        if toxic:
            words[int(rng.integers(80))] = str(rng.choice(["vile", "awful", "stemmed", "stemmer", "stemming"]))
            words[int(rng.integers(80))] = str(rng.choice(["vile", "awful", "stemmed", "stemmer", "stemming"]))
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    found = {r["doc_id"]: r for r in toxicity.toxicity_scores(make_docs(*rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [(r["predicted"], i % 9 == 0) for i, r in found.items() if r["held_out"]]
    assert sum(p for p, t in held if t) >= 0.6 * sum(t for _, t in held)
    assert sum(p for p, t in held if not t) <= 0.02 * len(held)


def plain_features(text):
    """A text's words and word beginnings, told plainly, as hashes."""
    out = set()
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode().lower()):
        for n in (None, *toxicity.PREFIXES):
            if n is None or len(w) >= n:
                part = w[:n]
                h = bytefeat.span_hashes(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]))
                out.add(int((h if n is None else bytefeat.mix(h + np.uint64(n)))[0]))
    return out


def test_toxicity_scores_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    words, weights, bias = toxicity.learn(docs, labels)
    weight = dict(zip(words.tolist(), weights.tolist()))
    assert len(weight) > 3
    found = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    for r in docs.where("length(text) < 2000").limit(150).collect():
        z = bias + sum(weight.get(h, 0.0) for h in plain_features(r["text"]))
        row = found[r["doc_id"]]
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6) and row["predicted"] == (row["score"] >= 0.5) and row["held_out"] == (fold(r["doc_id"]) == 0)


def test_features_of_a_model_against_brute_force(spark, make_docs):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 60, 12)) + (" vileness" if i % 4 == 0 else "")) for i in range(200)]
    docs = make_docs(*rows).selectExpr("doc_id", "cast(text as binary) as text")
    n_u, counts = toxicity.counts_of(docs, words := np.sort(np.array(sorted(plain_features(" ".join(t for _, t in rows))), np.uint64)))
    own = [plain_features(t) for _, t in rows]
    assert n_u == 200 and counts.tolist() == [sum(int(w) in x for x in own) for w in words]
    for at, to, row, place in toxicity.Known(words).places([t.encode() for _, t in rows]):
        pairs = list(zip(row.tolist(), words[place].tolist()))
        assert len(set(pairs)) == len(pairs) and set(pairs) == {(k - at, h) for k in range(at, to) for h in own[k]}


def test_risk_estimator_is_not_negative():
    rng = np.random.default_rng(0)
    draw = lambda n, extra: [np.unique(np.concatenate([rng.integers(0, 40, 12), np.array(extra, np.int64)])) for _ in range(n)]
    positives, unlabelled = draw(60, [50, 51]), draw(500, []) + draw(60, [50, 51])
    w, b = toxicity.fit(positives, unlabelled, 60, 60 / 560, 1)
    assert min(w[50], w[51]) > np.abs(w[:40]).max() and b < 0


def test_toxicity_of_odd_rows(spark, make_docs):
    docs = make_docs((1, None), (1, None), (2, ""), (None, "bad words"), (3, "bad " * 30_000)).withColumnRenamed("n_chars", "positive")
    for rows in ([], [(3, 1), (2, 0), (77, 1), (None, 0)], [(1, 1)]):
        labels = spark.createDataFrame([(d, 1, t) for d, t in rows], "doc_id long, quality int, toxic int")
        found = toxicity.toxicity_scores(docs, labels).collect()
        assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)
        if not rows:
            assert all(r["score"] == 0 for r in found)
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


# ---- language


def test_languages_of_pages(spark):
    found = language_id.op2_language_fusion(spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert sum(r["lang"] == r["text_lang"] for r in found) >= 0.95 * len(found)
    assert all(0 < r["confidence"] <= 1 + 1e-9 for r in found)


def test_evidence_is_fused(spark, make_docs):
    docs = spark.createDataFrame([(i, "the house and the garden with that" if i % 2 else "das haus und der garten mit dem", "en" if i % 2 else "de", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    html = lambda lang, text: f"<html lang='{lang}'><script>the the</script><body>{text}</body></html>"
    pages = [(i, f"https://a.site.de/{i}", html("de", "das haus und der garten")) for i in range(30)] + [(i, f"https://b.other.com/{i}", html("en", "the house and the garden")) for i in range(30, 60)]
    pages += [(100, "https://a.site.de/x", "<html><body>12 34</body></html>"), (101, None, html("en", "")), (102, "odd", None), (102, "odd", None)]
    found = {r["page_id"]: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert found[0]["lang"] == "de" and found[40]["lang"] == "en"
    assert found[100]["lang"] == "de"  # nothing but its host speaks
    assert found[101]["lang"] == "en" and found[101]["text_lang"] is None
    assert found[102]["host"] == "" and found[102]["lang"] in ("de", "en")
    assert sum(found[0]["posterior"]) == pytest.approx(1)


def plain_fusion(pages, docs):
    """lang and posterior of every page, from plain counts. pages: (id, host, suffix, declared, text); docs: (lang, text)."""
    langs = sorted({lang for lang, text in docs if lang and text is not None})
    bucket = lambda g: int(bytefeat.inner_grams(np.frombuffer(g.encode(), np.uint8), 3)[2][0]) % language_id.BUCKETS
    white = " \t\n\r\x0b\x0c"

    def grams(text):
        chars = text.lower() + "\n"
        return [bucket(chars[i : i + 3]) for i in range(len(chars) - 2) if chars[i + 1] not in white]

    counts = {lang: Counter() for lang in langs}
    for lang, text in docs:
        if lang and text is not None:
            counts[lang].update(grams(text))
    total = {lang: sum(c.values()) + 0.5 * language_id.BUCKETS for lang, c in counts.items()}
    likely = [{lang: language_id.TEXT_WEIGHT * sum(math.log((counts[lang][g] + 0.5) / total[lang]) for g in grams(p[4])) for lang in langs} for p in pages]
    votes = [max(langs, key=lambda x: (own[x], -langs.index(x))) if any(own.values()) else None for own in likely]
    site = lambda host: ".".join(host.split(".")[-2:])
    keys = [{"host": p[1], "site": site(p[1]), "suffix": p[2], "declared": p[3]} for p in pages]
    out = {}
    n_all = Counter(v for v in votes if v)
    every = sum(n_all.values())
    for own, key, vote, p in zip(likely, keys, votes, pages):
        others = lambda name: Counter(v for k, v in zip(keys, votes) if v and k[name] == key[name]) - Counter([vote] if vote else [])  # noqa: E731, B023
        tally = {name: others(name) for name in key}
        logs = {}
        for lang in langs:
            base = (n_all[lang] + language_id.EVIDENCE_COUNT) / (every + language_id.EVIDENCE_COUNT * len(langs))
            smooth = lambda name, wider: (tally[name][lang] + language_id.HOST_COUNT * wider) / (sum(tally[name].values()) + language_id.HOST_COUNT)  # noqa: E731, B023
            prior = smooth("host", smooth("site", base))
            speaks = lambda name: (tally[name][lang] + language_id.EVIDENCE_COUNT * (sum(tally[name].values()) + 1) / (every + 1)) / (n_all[lang] - (vote == lang) + language_id.EVIDENCE_COUNT)  # noqa: E731, B023
            logs[lang] = own[lang] + math.log(prior) + math.log(speaks("suffix")) + (math.log(speaks("declared")) if key["declared"] else 0.0)
        top = max(logs.values())
        scale = sum(math.exp(x - top) for x in logs.values())
        out[p[0]] = (max(langs, key=lambda x: (logs[x], -langs.index(x))), [math.exp(logs[x] - top) / scale for x in langs])
    return out


def test_fusion_against_brute_force(spark):
    """All evidence of every page, counted plainly from the page's own parts."""
    words = {"en": "the house and a garden with this", "de": "das haus und ein garten mit dem", "fr": "la maison et un jardin avec cette"}
    rng = np.random.default_rng(9)
    say = lambda lang, n: " ".join(rng.choice(words[lang].split(), n))
    docs = [(lang, say(lang, 12)) for lang in words for _ in range(8)] + [(None, "das das"), ("en", None)]
    pages = []
    for i in range(90):
        lang = list(words)[int(rng.integers(3))]
        host = str(rng.choice(["a.x.com", "b.x.com", "haus.de", "www.jardin.fr", "m.jardin.fr", ""]))
        declared = str(rng.choice(["", lang, "en"]))
        pages.append((i, host, host.split(".")[-1], declared, say(lang, int(rng.integers(0, 6)))))
    table = [(i, f"https://{host}/p{i}" if host else None, f"<html lang='{declared}'><p>{text}</p></html>" if declared else f"<p>{text}</p>") for i, host, _, declared, text in pages]
    df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: r for r in language_id.identify(df, spark.createDataFrame(docs, "lang string, text string").repartition(2)).collect()}
    text_of = {r["page_id"]: r["text"] for r in language_id.page_evidence(df).collect()}
    want = plain_fusion([(i, host, suffix, declared, text_of[i]) for i, host, suffix, declared, _ in pages], docs)
    for i, (lang, posterior) in want.items():
        assert found[i]["posterior"] == pytest.approx(posterior, rel=1e-4, abs=1e-9)
        assert found[i]["lang"] == lang or sorted(posterior)[-1] - sorted(posterior)[-2] < 1e-6


def test_odd_pages(spark, make_docs):
    """Very long pages, repeated rows, ties between languages and columns of the operator's own names."""
    docs = spark.createDataFrame([("en", "aaa bbb"), ("de", "aaa bbb"), (None, "ccc"), ("fr", None)], "lang string, text string")
    long = "<p>" + "aaa bbb " * 60_000 + "</p>"
    rows = [(1, "http://a.b/x", long), (2, None, "<p>aaa</p>"), (2, None, "<p>aaa</p>"), (None, "", ""), (4, "http://a.b/y", "<html lang=de>aaa</html>")]
    pages = spark.createDataFrame([(*r, "h", 7, "t") for r in rows], "page_id long, url string, html string, host string, vote int, text string").repartition(2)
    found = language_id.identify(pages, docs).collect()
    assert sorted(str(r["page_id"]) for r in found) == ["1", "2", "2", "4", "None"]
    by = {r["page_id"]: r for r in found}
    assert by[1]["lang"] == by[2]["lang"] == by[None]["lang"] == "de" and by[1]["text_lang"] == "de"  # the first in code-point order
    assert all(len(r["posterior"]) == 2 and sum(r["posterior"]) == pytest.approx(1) for r in found)


def test_no_pages_and_no_documents(spark, make_docs):
    pages = spark.createDataFrame([(1, "http://x.com/", "<p>hi</p>")], "page_id long, url string, html string")
    docs = make_docs((1, None), (2, "x")).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    assert language_id.identify(pages, docs).first()["lang"] is None
    assert language_id.identify(pages.limit(0), make_docs((1, "the house"))).count() == 0
