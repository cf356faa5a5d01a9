"""Readers and writers: Markdown and code trees, manifests, user lists, cases, reports."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of code files.
LANGUAGES = {"python": ["py"], "cpp": ["c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx", "cu", "cuh"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, modified, size) of all Markdown files below root."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"))


def code(spark: SparkSession, root: str, repository: str) -> DataFrame:
    """Code files below root with their language, digest and line count."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    end = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.when(end.isin(LANGUAGES["python"]), "python").when(end.isin(LANGUAGES["cpp"]), "cpp")
    text = F.make_valid_utf8(F.col("content").cast("string"))  # bytes that are no UTF-8 become U+FFFD
    lines = F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0)
    return rows.select(F.lit(repository).alias("repository_id"), "path", language.alias("language"), text.alias("full_content"), F.sha2("content", 256).alias("content_sha256"), lines.alias("line_count")).filter("language is not null")


def signature(files: DataFrame) -> DataFrame:
    """One row: a digest of sorted path, time and size of all files."""
    one = F.concat_ws("|", "path", F.col("modified").cast("string"), F.col("size").cast("string"))
    return files.select(F.sha2(one, 256).alias("d")).groupBy(F.substring("d", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), "|"), 256).alias("d")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), "|"), 256).alias("signature"))


def write_json(spark: SparkSession, payload: dict, path: str, replace: bool = True) -> None:
    """A small document under a new name, then renamed in one step, so that readers see none of it or all. Without replace, FileExistsError where the path is taken."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    to, tmp = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(tmp)
    out.write(bytearray(json.dumps(payload, sort_keys=True, indent=2, ensure_ascii=False).encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE if replace else hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), fs.makeQualified(to), how)
    except Py4JJavaError as e:
        fs.delete(tmp, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise FileExistsError(path) from e
        raise


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a manifest; rows without id, key or source are left out."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")
    full = F.lit(True)
    for c in ("source_doc_id", "key", "source"):
        full = full & (F.coalesce(F.trim(F.col(c)), F.lit("")) != "")
    return rows.filter(full)


def user_list(lines: DataFrame) -> DataFrame:
    """(line, email, passwd) from numbered lines (line, value) of a CSV text; raises on what is not as it must be."""
    rows = lines.withColumn("cells", F.transform(F.split("value", ",", -1), lambda c: F.regexp_replace(c, r"^\s+", "")))
    head = rows.filter("line = 1").first()
    if head is None or [c.lstrip("﻿") for c in head["cells"]] != ["email", "passwd"]:
        raise ValueError("line 1: the header must be email,passwd")
    body = rows.filter("line > 1").filter(F.trim("value") != "")
    bad = body.filter((F.size("cells") != 2) | F.exists("cells", lambda c: F.trim(c) == "")).orderBy("line").first()
    if bad is not None:
        raise ValueError(f"line {bad['line']}: two cells that are not empty are needed")
    if body.isEmpty():
        raise ValueError("there are no users")
    return body.select("line", F.get("cells", F.lit(0)).alias("email"), F.get("cells", F.lit(1)).alias("passwd"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Routing cases from JSON lines; blank lines and lines that begin with # are left out."""
    rows = spark.read.text(path).filter((F.trim("value") != "") & ~F.trim(F.col("value")).startswith("#"))
    kind = "id string, category string, expected_use_rag boolean, question string, summary string, history array<struct<role: string, content: string>>"
    out = rows.select(F.from_json("value", kind).alias("c")).select("c.*")
    if out.isEmpty() or not out.filter(F.coalesce(F.trim("question"), F.lit("")) == "").isEmpty():
        raise ValueError("cases need questions")
    return out
