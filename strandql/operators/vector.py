"""Exact vector search: scores as native array arithmetic, the best by a bounded top-k; many queries as matrix products."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandql.plans.values import PipelineError

if TYPE_CHECKING:
    import numpy as np


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def score(v: Column, query: list[float], metric: str) -> Column:
    """cosine and dotProduct: (1 + s) / 2 within 0 and 1; euclidean: 1 / (1 + distance)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "euclidean":
        return 1 / (1 + F.sqrt(_sum(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)))))
    dot = _sum(F.zip_with(v, q, lambda a, b: a * b))
    if metric == "cosine":
        length = sum(float(x) ** 2 for x in query) ** 0.5
        dot = F.coalesce(F.try_divide(dot, F.sqrt(_sum(F.transform(v, lambda a: a * a))) * length), F.lit(0.0))
    elif metric != "dotProduct":
        raise PipelineError(f"unknown metric {metric}")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 + dot) / 2))


def top(df: DataFrame, v: Column, query: list[float], metric: str, limit: int, field: str) -> DataFrame:
    """The rows of the highest scores, with the score; vectors of another size are skipped."""
    own = v.cast("array<double>")
    return df.filter(F.size(v) == len(query)).withColumn(field, score(own, query, metric)).orderBy(F.col(field).desc()).limit(limit)


#: Scores that a task holds at a time.
PAIRS = 1 << 21


def neighbours(rows: DataFrame, queries: DataFrame, key: str, vector: str, limit: int, metric: str = "cosine", block: int = 8192) -> DataFrame:
    """query, the key and the score of the best rows for each of many queries (columns key and vector), exact.

    The queries go to the executors a block at a time, one pass over the rows a block. A task multiplies its batches with
    the block as matrices and keeps the best of each query, so the rest of the work is limit rows a task and query.
    Vectors of another size than the query's, and nulls, are skipped; ties go to the smaller key.
    """
    if metric not in ("cosine", "dotProduct", "euclidean"):
        raise PipelineError(f"unknown metric {metric}")
    spark = rows.sparkSession
    source = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    shape, out, held = "query long, key long, score double", None, []

    def found(own: list[tuple[int, list[float]]]) -> DataFrame:
        import numpy as np

        by_size: dict[int, list[tuple[int, list[float]]]] = {}
        for q in own:
            by_size.setdefault(len(q[1]), []).append(q)
        shared = spark.sparkContext.broadcast({n: (np.array([k for k, _ in qs]), np.array([v for _, v in qs], float)) for n, qs in by_size.items()})  # a block of queries

        def run(batches):
            import pyarrow as pa

            best: dict[int, tuple] = {}
            for batch in batches:
                keys, vectors = batch.column(0).to_numpy(), batch.column(1)
                sizes = np.diff(vectors.offsets.to_numpy())
                flat, begin = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
                for n, (_, q) in shared.value.items():
                    all_at = np.flatnonzero(sizes == n)
                    room = max(1, PAIRS // len(q))
                    for at in (all_at[lo : lo + room] for lo in range(0, len(all_at), room)):
                        s = similarity(q, flat[begin[at][:, None] + np.arange(n)], metric)
                        old = best.get(n, (np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)))
                        s, k = np.concatenate([old[0], s], axis=1), np.concatenate([old[1], np.broadcast_to(keys[at], (len(q), len(at)))], axis=1)
                        order = np.lexsort((k, -s))[:, :limit]
                        best[n] = np.take_along_axis(s, order, 1), np.take_along_axis(k, order, 1)
            for n, (s, k) in best.items():
                ids = np.repeat(shared.value[n][0], s.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k.ravel(), pa.int64()), pa.array(s.ravel())], ["query", "key", "score"])

        return source.mapInArrow(run, shape)

    for row in queries.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).where(f"`{vector}` is not null").toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == block:
            out, held = (found(held) if out is None else out.union(found(held))), []
    if held:
        out = found(held) if out is None else out.union(found(held))
    if out is None:
        out = spark.createDataFrame([], shape)
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query", F.col("key").alias(key), "score", "rank")


def similarity(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """The score of every row for every query, as score gives it."""
    import numpy as np

    if metric == "euclidean":
        d = (queries * queries).sum(axis=1)[:, None] + (rows * rows).sum(axis=1)[None] - 2 * queries @ rows.T
        return 1 / (1 + np.sqrt(np.maximum(d, 0)))
    s = queries @ rows.T
    if metric == "cosine":
        size = np.sqrt((queries * queries).sum(axis=1))[:, None] * np.sqrt((rows * rows).sum(axis=1))[None]
        s = np.divide(s, size, out=np.zeros_like(s), where=size > 0)
    return np.clip((1 + s) / 2, 0, 1)
