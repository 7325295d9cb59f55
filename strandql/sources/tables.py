"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders made within the innermost scratch of this thread.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local master gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="strandql-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def cut(df: DataFrame, name: str = "cut", compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read back: a short lineage whose files outlive any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.folder = path  # type: ignore[attr-defined]
    return made


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables made by cut, once nothing reads them any more."""
    for df in tables:
        remove(df.sparkSession, df.folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Folders made within are removed at the end, but for those taken out of the list: results must be stored or collected by then."""
    made: list[str] = []
    before = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(before)
        for path in made:
            remove(spark, path)


def folder_bytes(df: DataFrame) -> int:
    """Bytes of the files of a stored table."""
    spark, total = df.sparkSession, 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total
