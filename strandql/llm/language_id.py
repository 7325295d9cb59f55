"""Language identification by Bayesian evidence fusion.

Evidence for each page: the likelihood of its visible text under character-trigram models learned from all labelled
documents; the language that its markup declares; the suffix of its address; and a prior of its host. How far a
declaration or a suffix speaks for a language is counted over all pages by grouped aggregation against what the text
alone says; host priors are counts smoothed towards those of the site (the last two labels), and these towards the
global ones, each page's own vote taken out. The posterior multiplies all four and is normalised.

Counts are kept by (language, trigram bucket), (declared, language), (suffix, language), (site, language) and (host,
language); only the first, of fixed size, reaches the driver. Defined cases: null or empty html has no text and no
declaration, so the other evidence decides; a null or odd url has the host "" and the suffix ""; documents without text
or language teach nothing; without any labelled document the language is null; repeated rows are judged one by one;
ties go to the language first in code-point order; very long pages and texts are read whole; more than MOST_LANGUAGES
languages are an error; an empty table of pages gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandql.llm import bytefeat, common

BUCKETS = 1 << 15
MOST_LANGUAGES = 256
#: Trigrams of a text depend on each other: so much of their log likelihood counts.
TEXT_WEIGHT = 0.25
#: Pseudo-counts: of the evidence tables, and of the wider level in the narrower one's prior.
EVIDENCE_COUNT, HOST_COUNT = 1.0, 5.0


def trigrams(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, one past the last, bucket of every trigram, number of its text counted from the first)."""
    for at, to, buf, offsets in bytefeat.chunks(texts):
        place, end, gram = bytefeat.inner_grams(buf, 3)
        own = np.searchsorted(offsets, place, "right") - 1
        whole = end <= offsets[own + 1]
        yield at, to, (gram[whole] % np.uint64(BUCKETS)).astype(np.int64), own[whole]


def text_models(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log probabilities of the trigram buckets under each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, _, buckets, owner in trigrams([t.lower().encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]):
                codes = {lang: k for k, lang in enumerate(sorted(set(langs)))}
                which = np.array([codes[x] for x in langs])[at + owner] if len(owner) else owner
                found = np.bincount(which * BUCKETS + buckets, minlength=len(codes) * BUCKETS).reshape(len(codes), BUCKETS)
                for lang, k in codes.items():
                    seen[lang] = seen.get(lang, 0) + found[k]
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    src = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    langs = sorted(r["lang"] for r in src.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = src.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x BUCKETS
    counts = np.full((len(langs), BUCKETS), 0.5)
    number = {lang: k for k, lang in enumerate(langs)}
    at = np.array([number[x] for x in rows.column("lang").to_pylist()], np.int64)
    counts[at, rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)) if langs else counts


def visible_text(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags out, the common entities resolved."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, site, suffix, declared, text of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1)).alias("declared"), visible_text(html).alias("text"))
    return rows.withColumn("site", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))


def identify(pages: DataFrame, docs: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """page_id, host, declared, suffix, text_lang, lang, confidence, posterior (by language, in code-point order)."""
    spark = pages.sparkSession
    common.bounded_batches(spark)
    langs, models = text_models(docs, text_col, lang_col)
    shared = spark.sparkContext.broadcast(models.astype(np.float32))  # MOST_LANGUAGES x BUCKETS at most
    width = len(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros((batch.num_rows, width))
            for at, to, buckets, owner in trigrams([t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in batch.column(4).to_pylist()]):
                for k in range(width):
                    scores[at:to, k] = TEXT_WEIGHT * np.bincount(owner, shared.value[k][buckets], to - at)
            best = scores.argmax(axis=1) if width else np.zeros(batch.num_rows, np.int64)
            clear = (np.abs(scores).max(axis=1) > 0) if width else np.zeros(batch.num_rows, bool)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), batch.column(5), pa.array(scores.tolist(), pa.list_(pa.float64())), pa.array(np.where(clear, best, -1), pa.int32())], ["page_id", "host", "site", "suffix", "declared", "likely", "vote"])

    src = page_evidence(pages, id_col, url_col, html_col).select("page_id", "host", "site", "suffix", "text", "declared")
    rows = common.materialize(src.mapInArrow(run, "page_id long, host string, site string, suffix string, declared string, likely array<double>, vote int"), "pages")
    votes = rows.where("vote >= 0")
    tally = [F.sum((F.col("vote") == k).cast("double")) for k in range(width)]

    def counted(by: str | None, name: str) -> DataFrame:
        own = votes.groupBy(by) if by else votes.groupBy()
        return own.agg(F.array(*[F.coalesce(t, F.lit(0.0)) for t in tally]).alias(name))

    whole = counted(None, "all").first()["all"] if width else []
    total = sum(whole)
    prior = [(c + EVIDENCE_COUNT) / (total + EVIDENCE_COUNT * width) for c in whole]
    base, size = F.array(*map(F.lit, prior)), F.array(*map(F.lit, whole))
    found = rows
    for by in ("declared", "suffix", "site", "host"):
        found = found.join(counted(by, f"n_{by}"), by, "left")
    zero = F.array(*[F.lit(0.0)] * width)
    own = lambda k: F.when(F.col("vote") == k, F.lit(1.0)).otherwise(F.lit(0.0))
    logs = []
    for k in range(width):
        at = lambda name: F.coalesce(F.col(name), zero)[k] - own(k)  # noqa: E731, B023
        said = lambda name: F.aggregate(F.coalesce(F.col(name), zero), F.lit(0.0), lambda a, x: a + x) - F.when(F.col("vote") >= 0, 1.0).otherwise(0.0)
        site = (at("n_site") + HOST_COUNT * base[k]) / (said("n_site") + HOST_COUNT)
        host = (at("n_host") + HOST_COUNT * site) / (said("n_host") + HOST_COUNT)
        # P(what is seen | language): smoothed towards how often it is seen at all.
        speaks = lambda name: (at(name) + EVIDENCE_COUNT * (said(name) + 1) / (total + 1)) / (size[k] - own(k) + EVIDENCE_COUNT)  # noqa: E731, B023
        evidence = [F.log(host), F.log(speaks("n_suffix")), F.when(F.col("declared") == "", F.lit(0.0)).otherwise(F.log(speaks("n_declared")))]
        logs.append(F.col("likely")[k] + evidence[0] + evidence[1] + evidence[2])
    names = F.array(*map(F.lit, langs)) if width else F.array().cast("array<string>")
    found = found.withColumn("logs", F.array(*logs) if width else F.array().cast("array<double>"))
    found = found.withColumn("top", F.array_max("logs")).withColumn("raised", F.transform("logs", lambda x: F.exp(x - F.col("top"))))
    found = found.withColumn("sum", F.aggregate("raised", F.lit(0.0), lambda a, x: a + x)).withColumn("posterior", F.transform("raised", lambda x: x / F.col("sum")))
    best = F.array_position("logs", F.col("top")).cast("int")
    return found.select("page_id", "host", F.col("declared"), "suffix", F.when(F.col("vote") >= 0, F.get(names, F.col("vote"))).alias("text_lang"), F.get(names, best - 1).alias("lang"), F.array_max("posterior").alias("confidence"), "posterior")


def op2_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(common.table(spark, sf_dir, "pages"), common.table(spark, sf_dir, "documents"))
    return found.drop("posterior")
