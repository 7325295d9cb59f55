"""Text search: tokens of indexed fields, tf-idf scores, every search token required."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandql.plans.context import frame
from strandql.plans.values import PipelineError, resolve


def tokens_of(search: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\w+", search.lower())))


def search(df: DataFrame, query: str, fields: dict[str, float] | list[str], key: str = "_id", score: str = "_textScore") -> DataFrame:
    """Rows of df that hold every token of the query, with their score: sum of weight * (1 + ln tf) * (1 + ln(N / df)).

    Only the query's tokens are ever counted; texts are tokenized in one pass and never gathered.
    """
    wanted = tokens_of(query)
    weights = dict(fields) if isinstance(fields, dict) else dict.fromkeys(fields, 1.0)
    if not wanted:
        return df.limit(0).withColumn(score, F.lit(0.0))
    root = frame(df)
    columns = {p: resolve(root, p) for p in weights}
    if missing := [p for p, v in columns.items() if v is None or not v.is_string]:
        raise PipelineError(f"no text at {missing}")
    counts = []
    for token in wanted:
        # \w in Java is ASCII unless the U flag is set.
        own = {p: F.coalesce(F.regexp_count(F.lower(v.col), F.lit(rf"(?U)(?<!\w){re.escape(token)}(?!\w)")), F.lit(0)) for p, v in columns.items()}
        counts.append(own)
    hits = {f"__c{i}_{j}": c for i, own in enumerate(counts) for j, c in enumerate(own.values())}
    held = df.withColumns(hits)
    found = [sum((F.col(f"__c{i}_{j}") for j in range(len(weights))), F.lit(0)) > 0 for i in range(len(wanted))]
    stats = held.agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f.cast("long")).alias(f"__df{i}") for i, f in enumerate(found)])
    every = found[0]
    for f in found[1:]:
        every = every & f
    rows = held.filter(every).crossJoin(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log(F.col("__n") / F.col(f"__df{i}")) + 1
        for j, w in enumerate(weights.values()):
            tf = F.col(f"__c{i}_{j}")
            total = total + F.when(tf > 0, F.lit(float(w)) * (1 + F.log(tf.cast("double"))) * idf).otherwise(0.0)
    return rows.withColumn(score, total).drop(*hits, *stats.columns)
