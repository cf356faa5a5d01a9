"""Several tables that grow by batches and are seen together: a batch's rows in all of them, or in none."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import write_json
from ..sources.scratch import delete


class CommittedTables:
    """Each batch writes folders of its own; what makes them part of the tables is one file that names them, written last and once.

    A commit is known by its query and batch, so a batch that is run again after its commit does nothing, and one that has failed before its
    commit leaves folders that nobody reads. The driver reads one small file for each commit.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, query: str, batch: int) -> str:
        return f"{self.root}/commits/{query}-{batch:012d}.json"

    def committed(self, query: str, batch: int) -> bool:
        return self._fs.exists(self._path(self._file(query, batch)))

    def commits(self) -> list[dict]:
        """All commits in their order: {number, query, batch, folders}."""
        if not self._fs.exists(self._path(f"{self.root}/commits")):
            return []
        rows = self.spark.read.option("pathGlobFilter", "*.json").text(f"{self.root}/commits", wholetext=True).collect()
        return sorted((json.loads(r[0]) for r in rows), key=lambda c: (c["number"], c["query"], c["batch"]))

    def read(self, table: str, schema: str) -> DataFrame:
        """The table's rows in all commits, with `_commit`, the number of theirs."""
        out = self.spark.createDataFrame([], f"{schema}, _commit long")
        folders = [c["folders"][table] for c in self.commits() if table in c["folders"]]
        if not folders:
            return out
        rows = self.spark.read.schema(f"{schema}, _commit long").option("basePath", f"{self.root}/{table}")
        return rows.parquet(*folders).select(out.columns)

    def commit(self, query: str, batch: int, tables: dict[str, DataFrame], by: dict[str, str] | None = None) -> bool:
        """Adds a batch's rows to all tables at once; False where it has been added before. by: columns that part tables into folders."""
        if self.committed(query, batch):
            return False
        number = max((c["number"] for c in self.commits()), default=0) + 1
        folders = {}
        try:
            for name, df in tables.items():
                folders[name] = f"{self.root}/{name}/part={query}-{batch:012d}-{uuid.uuid4().hex}"
                parted = [(by or {})[name]] if name in (by or {}) else []
                df.withColumn("_commit", F.lit(number).cast("long")).write.partitionBy(*parted).parquet(folders[name])
            self._fs.mkdirs(self._path(f"{self.root}/commits"))
            write_json(self.spark, {"number": number, "query": query, "batch": batch, "folders": folders}, self._file(query, batch), replace=False)
        except FileExistsError:  # another run of the same batch was first
            for f in folders.values():
                delete(self.spark, f)
            return False
        return True
