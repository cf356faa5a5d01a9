"""A table of vectors by what they are of: the digest of a text and the model, task and prompt that encode it."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import Encoder, encode_options, encoded


class VectorCache:
    """Texts are encoded once for each model, task and prompt; texts that have a vector are found by an anti-join and not sent to the model.

    Vectors are added in new files only, so a task or run that fails leaves the others as they are. Two writers at once may both encode
    a text; readers take one vector for each digest. Null texts count as empty ones.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, model: str, options: dict[str, str], normalize: bool) -> str:
        key = json.dumps([model, options, normalize], sort_keys=True)
        return f"{self.root}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"

    def _stored(self, folder: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        rows = self.spark.read.schema("digest string, embedding array<double>")
        return rows.option("recursiveFileLookup", True).parquet(folder) if there else self.spark.createDataFrame([], "digest string, embedding array<double>")

    def size(self, model: str, *, task: str | None = None, prompt: str | None = None, normalize: bool = True) -> int:
        return self._stored(self._folder(model, encode_options(task, prompt), normalize)).select("digest").distinct().count()

    def fill(self, texts: DataFrame, text: str, load: Callable[[], Encoder], model: str, *, task: str | None = None, prompt: str | None = None, batch: int = 64, normalize: bool = True) -> None:
        """Encodes those texts that have no vector yet, each distinct one once."""
        folder = self._folder(model, encode_options(task, prompt), normalize)
        clean = F.coalesce(F.col(text), F.lit(""))
        asked = texts.select(F.sha2(clean, 256).alias("digest"), clean.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
        new = asked.join(self._stored(folder).select("digest"), "digest", "left_anti")
        out = f"{folder}/{uuid.uuid4().hex}"
        encoded(new, "text", load, task=task, prompt=prompt, batch=batch, normalize=normalize).select("digest", "embedding").write.parquet(out)

    def encoded(self, rows: DataFrame, text: str, load: Callable[[], Encoder], model: str, *, task: str | None = None, prompt: str | None = None, batch: int = 64, normalize: bool = True) -> DataFrame:
        """rows with `embedding`, one of that name being replaced; only what the table lacks is encoded."""
        self.fill(rows, text, load, model, task=task, prompt=prompt, batch=batch, normalize=normalize)
        known = self._stored(self._folder(model, encode_options(task, prompt), normalize)).dropDuplicates(["digest"])
        keyed = rows.drop("embedding").withColumn("_digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        return keyed.join(known.withColumnRenamed("digest", "_digest"), "_digest").drop("_digest")
