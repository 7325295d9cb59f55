"""Intermediate tables and small text helpers of the llm operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandql.sources import tables
from strandql.sources.tables import discard, fresh_path, remove, scratch, shared_dir  # noqa: F401 - the operators' names for them

#: Words of every contract here: maximal runs of anything but the ASCII white space characters.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
#: An Arrow batch holds at most so many bytes of text, so that very long documents do not meet in one batch.
BATCH_BYTES = 16 << 20
#: Rows that one labelled id brings to a training sample, about.
ROWS_OF_ID = 4


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut by files that survive a lost executor."""
    return tables.cut(df, name, "zstd")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that Python workers get, where the session does not set a bound of its own.

    The settings hold for the session, as the plans made here run after this call.
    """
    for key, usual, own in (("maxBytesPerBatch", "67108864b", BATCH_BYTES), ("maxRecordsPerBatch", "10000", 2000)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) == usual:
            spark.conf.set(key, str(own))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none. Spark's regular expressions run in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_sample(df: DataFrame, n: int, key: str, *ties: str, total: int | None = None) -> DataFrame:
    """The n rows whose key has the smallest hashes. Of a large table only about 2 n rows are ever ordered; total: its rows, if known."""
    total = df.count() if total is None else total
    mark = F.pmod(F.xxhash64(key), F.lit(1 << 31))
    if total > 4 * n:
        df = df.where(mark < int((1 << 31) * 2 * n / total) + 1)
    return df.orderBy(mark, key, *ties).limit(n)


def labelled_rows(src: DataFrame, chosen: DataFrame) -> DataFrame:
    """src joined to chosen by doc_id; chosen has a bounded number of rows, which go to the executors.

    Where an id stands on more rows of src than ROWS_OF_ID, about so many of them, by a hash of the row, are taken.
    """
    ids = chosen.select("doc_id").distinct()
    often = src.select("doc_id").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.count("*").alias("__n")).where(F.col("__n") > ROWS_OF_ID)
    chosen = F.broadcast(chosen.join(often, "doc_id", "left"))
    numbered = src.withColumn("__row", F.monotonically_increasing_id())
    kept = F.col("__n").isNull() | (F.pmod(F.xxhash64("__row"), F.coalesce("__n", F.lit(1))) < ROWS_OF_ID)
    return numbered.join(chosen, "doc_id").where(kept).drop("__row", "__n")


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or with underscores behind it until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
