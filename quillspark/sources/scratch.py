"""Tables and folders in the storage that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that are to meet in a task, and bytes up to which files and partitions of a finer job are joined.
ROWS, BYTES = 1 << 20, "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and the master local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def pieces(spark: SparkSession, rows: int) -> int:
    """Partitions that keep about ROWS of so many rows in a task; the session's, where these are more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df of so many rows dealt by columns to pieces; as it is where the session's partitions are enough."""
    n = pieces(df.sparkSession, rows)
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


@contextmanager
def finer(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run meanwhile over so many rows are dealt so that a task's memory does not grow with them."""
    key, n = "spark.sql.shuffle.partitions", pieces(spark, rows)
    more = {key: str(n), "spark.sql.adaptive.advisoryPartitionSizeInBytes": BYTES, "spark.sql.files.maxPartitionBytes": BYTES}
    before = {k: spark.conf.get(k) for k in more} if n > int(spark.conf.get(key)) else {}
    try:
        for k in before:
            spark.conf.set(k, more[k])
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, name: str = "scratch", rows: int = 0) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, and safe from lost executors. rows: that it comes from, where these are many."""
    path = fresh_dir(df.sparkSession, name)
    with finer(df.sparkSession, rows):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    for t in tables:
        delete(t.sparkSession, t._scratch)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores where it comes from fewer files than there are cores, as a file of one row group is one task's; else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
