"""Changes to tables as rewrites: inserts, upserts, cascades, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet are added; others change nothing."""
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of their key."""
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def upsert_where(table: DataFrame, rows: DataFrame, keys: list[str], changes: dict[str, Column], where: Column) -> DataFrame:
    """New keys are added; of a key that is there, `changes` are set where `where` holds. Both read the old values by name and the new ones as `new.<column>`; rows has a key once."""
    new = rows.select(*keys, F.struct(*[F.col(c) for c in rows.columns]).alias("new"))
    both = table.join(new, keys, "left")
    hit = F.col("new").isNotNull() & F.coalesce(where, F.lit(False))
    kept = both.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns])
    return kept.unionByName(rows.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def insert_all_or_none(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the batch, or fails as a whole on a key that repeats in it or exists."""
    twice = rows.groupBy(*keys).count().filter("count > 1").limit(1).count()
    there = rows.join(table.select(*keys), keys, "left_semi").limit(1).count()
    if twice or there:
        raise ValueError("a key of the batch repeats or exists")
    return table.unionByName(rows.select(*table.columns))


def cascade(parents: DataFrame, children: list[tuple[DataFrame, str, str]], gone: Column, key: str) -> list[DataFrame]:
    """Parents without those that are gone, then each child table without rows whose parent went. children: (table, foreign key, own key)."""
    lost, out = parents.filter(gone).select(F.col(key).alias("_k")), [parents.filter(~gone)]
    for table, foreign, own in children:
        lost = lost.withColumnRenamed("_k", foreign)
        out.append(table.join(lost, foreign, "left_anti").select(*table.columns))
        lost = table.join(lost, foreign, "left_semi").select(F.col(own).alias("_k"))
    return out


def violations(df: DataFrame, unique: list[list[str]], checks: dict[str, Column]) -> DataFrame:
    """(rule, n): keys that repeat and rows that break a check."""
    out = None
    for keys in unique:
        one = df.groupBy(*keys).count().filter("count > 1").agg(F.lit("unique " + ",".join(keys)).alias("rule"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    for name, ok in checks.items():
        one = df.filter(~F.coalesce(ok, F.lit(False))).agg(F.lit(f"check {name}").alias("rule"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def delete_matching(table: DataFrame, rows: DataFrame, keys: list[list[str]]) -> DataFrame:
    """The table without rows that agree with one of `rows` on any of several keys."""
    for k in keys:
        table = table.join(rows.select(*k).distinct(), k, "left_anti")
    return table


def replace_files(files: DataFrame, functions: DataFrame, edges: DataFrame, new_files: DataFrame, new_functions: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A code index with some files indexed anew: their old rows go by id or by repository and path, with functions and edges."""
    kept = delete_matching(files, new_files, [["file_id"], ["repository_id", "path"]])
    held = functions.join(kept.select("file_id"), "file_id", "left_semi")
    called = edges.join(held.select(F.col("id").alias("function_id")), "function_id", "left_semi")
    return kept.unionByName(new_files.select(*files.columns)), held.select(*functions.columns).unionByName(new_functions.select(*functions.columns)), called.select(*edges.columns).unionByName(new_edges.select(*edges.columns))
