"""An append-only change log and change streams over it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandql.operators.predicate import Predicate
from strandql.plans.context import frame

#: A column of changed documents: the fields that differ from before.
CHANGED = "__changed"
# The fields of a log entry (seq, behind ts, tells entries of one moment apart).
SCHEMA = T.StructType([
    T.StructField("ts", T.DoubleType()), T.StructField("seq", T.LongType()), T.StructField("ns", T.StringType()), T.StructField("op", T.StringType()), T.StructField("doc_id", T.StringType()),
    T.StructField("payload", T.StringType()), T.StructField("v", T.LongType()), T.StructField("checksum", T.StringType()), T.StructField("internal", T.BooleanType()),
    T.StructField("changed_fields", T.ArrayType(T.StringType())), T.StructField("node_id", T.StringType()),
])
OPERATIONS = ("insert", "update", "delete", "replace")


def entries(docs: DataFrame, ns: str, op: str, internal: bool = False, node: str = "local") -> DataFrame:
    """Log entries for changed documents."""
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != CHANGED]))
    key = F.col("_id").cast("string") if "_id" in docs.columns else F.lit(None).cast("string")
    return docs.select(
        F.unix_micros(F.current_timestamp()).cast("double").alias("ts") / 1e6, F.monotonically_increasing_id().alias("seq"), F.lit(ns).alias("ns"), F.lit(op).alias("op"), key.alias("doc_id"),
        payload.alias("payload"), F.lit(1).cast("long").alias("v"), F.sha2(payload, 256).alias("checksum"), F.lit(internal).alias("internal"),
        (F.col(CHANGED) if CHANGED in docs.columns else F.array().cast("array<string>")).alias("changed_fields"), F.lit(node).alias("node_id"),
    ).toDF(*SCHEMA.names)


def append(docs: DataFrame, path: str, ns: str, op: str, **options: Any) -> None:
    entries(docs, ns, op, **options).write.mode("append").parquet(path)


def ensure(spark: SparkSession, path: str) -> None:
    """Make an empty log where there is none, so that a stream can begin before the first change."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)


def read_from(spark: SparkSession, path: str, checkpoint: tuple[float, int] | None = None, skip_internal: bool = True) -> DataFrame:
    """Entries behind the checkpoint, in order."""
    log = spark.read.schema(SCHEMA).parquet(path)
    if checkpoint is not None:
        log = log.filter(F.struct("ts", "seq") > F.struct(F.lit(float(checkpoint[0])).alias("ts"), F.lit(int(checkpoint[1])).cast("long").alias("seq")))
    if skip_internal:
        log = log.filter(~F.coalesce("internal", F.lit(False)))
    return log.orderBy("ts", "seq")


def truncated(log: DataFrame, before: float) -> DataFrame:
    """What a retention limit leaves of a log."""
    return log.filter(F.col("ts") >= before)


def _keep(spark: SparkSession, path: str, kept: DataFrame, log: DataFrame) -> int:
    """Put the kept entries in the place of the log; how many went."""
    gone = log.count() - kept.count()
    if gone:
        new = f"{path}.kept"
        kept.write.mode("overwrite").parquet(new)
        old, made = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new))
        store = old.getFileSystem(spark._jsc.hadoopConfiguration())
        store.delete(old, True)
        store.rename(made, old)
    return gone


def truncate_before(spark: SparkSession, path: str, before: float) -> int:
    """Remove the entries before a moment; how many went. A stream over the log is started anew afterwards."""
    log = spark.read.schema(SCHEMA).parquet(path)
    return _keep(spark, path, truncated(log, before), log)


def truncate_count(spark: SparkSession, path: str, most: int) -> int:
    """Keep the newest entries, so many at most; how many went."""
    log = spark.read.schema(SCHEMA).parquet(path)
    excess = log.count() - most
    if excess <= 0:
        return 0
    # The newest of the entries that go: of all entries only the oldest are ordered, and no task sees them all.
    last = log.orderBy("ts", "seq").offset(excess - 1).limit(1).select("ts", "seq").first()
    here = F.struct("ts", "seq") > F.struct(F.lit(last["ts"]).alias("ts"), F.lit(last["seq"]).alias("seq"))
    return _keep(spark, path, log.filter(here), log)


def events(log: DataFrame, pipeline: list[dict[str, Any]] | None = None, db: str = "db", resume_after: dict[str, Any] | None = None) -> DataFrame:
    """Change events of a log, batch or stream; of the pipeline the first $match counts."""
    rows = log.filter(F.col("op").isin(*OPERATIONS) & ~F.coalesce("internal", F.lit(False)))
    if resume_after:
        rows = rows.filter((F.col("ts") > float(resume_after["ts"])) | ((F.col("ts") == float(resume_after["ts"])) & (F.col("seq") > int(resume_after["seq"]))))
    made = rows.select(
        F.col("op").alias("operationType"),
        F.struct(F.lit(db).alias("db"), F.col("ns").alias("coll")).alias("ns"),
        F.struct(F.col("doc_id").alias("_id")).alias("documentKey"),
        F.col("ts").alias("_ts"),
        F.struct("ts", "seq").alias("_token"),
        F.when(F.col("op") != "delete", F.col("payload")).alias("fullDocument"),
    )
    first = next((s["$match"] for s in pipeline or [] if "$match" in s), None)
    return made if first is None else made.filter(Predicate(frame(made))(first))


def change_stream(spark: SparkSession, path: str, pipeline: list[dict[str, Any]] | None = None, ns: str | None = None, resume_after: dict[str, Any] | None = None, db: str = "db") -> DataFrame:
    """A streaming DataFrame of change events; Structured Streaming's checkpoint is the resume point of a running query."""
    log = spark.readStream.schema(SCHEMA).parquet(path)
    if ns is not None:
        log = log.filter(F.col("ns") == ns)
    return events(log, pipeline, db, resume_after)
