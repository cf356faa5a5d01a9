"""What the operators of this subpackage share: tables, scratch tables, global order."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name, beginning with name, that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; a temporary one only where it is unset and the master local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: a short lineage that outlives lost executors. rows: most that go to a Python worker at once, as whole texts fill its memory and Spark's."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", None
    if rows:
        before = spark.conf.get(name)
        spark.conf.set(name, rows)
    try:
        df.write.parquet(path)
    finally:
        if rows:
            spark.conf.set(name, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for t in tables:
        discard(t.sparkSession, t._scratch)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans of the given starts and sizes, one span after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the Python worker gives freed memory back: workers outlive their tasks, and allocators hold on to it."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered(df: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """df range-partitioned and sorted by keys, with `_part` and `_pos` (row number from 0 in its part), as a scratch table.

    The numbers are stored, so that later jobs see one and the same order; global rank = rows in lower parts + `_pos`.
    """
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return cut(rows.select("*", F.spark_partition_id().alias("_part"), low.alias("_pos")))


def offsets(parts: DataFrame, total: Column) -> tuple[DataFrame, float]:
    """(`_part`, `_before`) and the grand total; one row for each partition, so small at any input size."""
    spark, before, rows = parts.sparkSession, 0, []
    for r in parts.groupBy("_part").agg(total.alias("t")).orderBy("_part").collect():
        rows.append((r["_part"], before))
        before = before + r["t"]
    kind = "double" if isinstance(before, float) else "long"
    return spark.createDataFrame(rows, f"_part int, _before {kind}"), before


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
