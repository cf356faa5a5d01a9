"""Versioned tables behind a pointer: build, switch, roll back, prune.

Readers resolve the pointer once for each query and then see one version of postings and vectors together; a switch adds a pointer with the next
number, which only one writer can.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .files import write_json


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def build(self, version: str, tables: dict[str, DataFrame], config: dict, by: dict[str, str] | None = None) -> None:
        """Writes a version; until it is switched to, nobody reads it. A half-written one of that name is replaced. by: columns that part tables into folders."""
        self._fs.delete(self._path(f"{self.root}/{version}"), True)
        for name, df in tables.items():
            folders = [(by or {})[name]] if name in (by or {}) else []
            df.write.partitionBy(*folders).parquet(f"{self.root}/{version}/{name}")
        write_json(self.spark, {"version": version, "tables": sorted(tables), "schemas": {n: df.schema.jsonValue() for n, df in tables.items()}, "config": config}, f"{self.root}/{version}/manifest.json")

    def _read(self, path: str) -> dict | None:
        if not self._fs.exists(self._path(path)):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _names(self, path: str) -> list[str]:
        where = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _pointer(self) -> tuple[int, dict]:
        """Number and content of the newest pointer. Pointers are numbered files; one that is there never changes."""
        names = [n for n in self._names(f"{self.root}/pointers") if n.endswith(".json")]
        return (int(names[-1].split(".")[0]), self._read(f"{self.root}/pointers/{names[-1]}") or {}) if names else (0, {})

    def active(self) -> str | None:
        return self._pointer()[1].get("version")

    def previous(self) -> str | None:
        return self._pointer()[1].get("previous")

    def switch(self, version: str, expected: str | None = None) -> None:
        """Makes a whole version the active one; fails if another than the expected one is active now, or if another writer switches meanwhile."""
        number, pointer = self._pointer()
        now = pointer.get("version")
        if expected is not None and now != expected:
            raise RuntimeError(f"{now} is active, not {expected}")
        if self.manifest(version) is None:
            raise ValueError(f"{version} is not whole")
        if now == version:
            return
        self._fs.mkdirs(self._path(f"{self.root}/pointers"))
        try:  # of two writers that have seen one pointer, one gets the next number
            write_json(self.spark, {"version": version, "previous": now}, f"{self.root}/pointers/{number + 1:012d}.json", replace=False)
        except FileExistsError as e:
            raise RuntimeError("another writer switched meanwhile") from e
        for name in self._names(f"{self.root}/pointers")[:-8]:
            self._fs.delete(self._path(f"{self.root}/pointers/{name}"), False)

    def manifest(self, version: str) -> dict | None:
        return self._read(f"{self.root}/{version}/manifest.json")

    def candidate(self) -> str | None:
        return (self._read(f"{self.root}/candidate.json") or {}).get("version")

    def prepare(self, version: str) -> None:
        """Announces a version that will be built; there is one at a time."""
        self._fs.mkdirs(self._path(self.root))
        try:
            write_json(self.spark, {"version": version}, f"{self.root}/candidate.json", replace=False)
        except FileExistsError as e:
            now = self.candidate()
            if now != version:
                raise RuntimeError(f"{now} is being prepared") from e

    def activate(self, version: str, expected: str | None = None) -> None:
        """Switches to the prepared version; does nothing where it is active already, fails for any other."""
        if self.active() == version:
            return
        if self.candidate() != version:
            raise RuntimeError(f"{version} is not prepared")
        self.switch(version, expected)
        self._fs.delete(self._path(f"{self.root}/candidate.json"), False)

    def discard(self, version: str) -> None:
        """Deletes the prepared version, whole or not; nothing happens for one that is not prepared."""
        if self.candidate() == version and self.active() != version:
            self._fs.delete(self._path(f"{self.root}/{version}"), True)
            self._fs.delete(self._path(f"{self.root}/candidate.json"), False)

    def rollback(self) -> str:
        before = self.previous()
        if before is None:
            raise ValueError("there is no version before")
        self.switch(before)
        return before

    def table(self, name: str, version: str | None = None) -> DataFrame:
        v = version or self.active()
        if v is None:
            raise ValueError("no version is active")
        kind = (self.manifest(v) or {}).get("schemas", {}).get(name)
        reader = self.spark.read.schema(StructType.fromJson(kind)) if kind else self.spark.read  # a table without rows may have no file
        return reader.parquet(f"{self.root}/{v}/{name}")

    def versions(self) -> list[str]:
        """Names of all versions, whole or not, the greatest first."""
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted((s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory() and s.getPath().getName() not in ("pointers", "segments")), reverse=True)

    def prune(self, keep: int) -> list[str]:
        """Deletes all but the active version and the newest others, keep in all; what is being prepared stays."""
        active, candidate = self.active(), self.candidate()
        others = [v for v in self.versions() if v not in (active, candidate)]
        gone = others[max(0, max(1, keep) - (active is not None)) :]
        for v in gone:
            self._fs.delete(self._path(f"{self.root}/{v}"), True)
        return gone

    def is_current(self, config: dict) -> bool:
        """Whether the active version was built with this configuration, so that a build can be spared."""
        v = self.active()
        return v is not None and (self.manifest(v) or {}).get("config") == config
