"""Accounts and collections: filters from dictionaries, sign-ins, guards, counts, ordered lookups, request batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def metadata_filter(rows: DataFrame, wanted: dict[str, object], missing: str = "") -> DataFrame:
    """Rows that equal all wanted values; empty values ask for nothing, columns that are missing count as `missing`; lists mean any of them."""
    for k, v in wanted.items():
        if v in (None, "", []):
            continue
        c = F.coalesce(F.col(k).cast("string"), F.lit(missing)) if k in rows.columns else F.lit(missing)
        rows = rows.filter(c.isin([str(x) for x in v]) if isinstance(v, list) else c == str(v))
    return rows


def signed_in(tokens: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not run out, with their active users."""
    return tokens.filter(F.col("expires_at") > now).join(users.filter("is_active"), "user_id")


def expired(tokens: DataFrame, now: Column) -> DataFrame:
    return tokens.filter(F.col("expires_at") <= now)


def may_demote(users: DataFrame) -> DataFrame:
    """users with `may_demote`: administrators only while another active one remains, never superusers."""
    admin = F.col("is_admin") & F.col("is_active")
    n = users.agg(F.sum(F.when(admin, 1).otherwise(0)).alias("n")).first()["n"] or 0
    return users.withColumn("may_demote", ~F.col("is_superuser") & (~admin | F.lit(n > 1)))


def counted(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str = "n") -> DataFrame:
    """Parents with the number of their children, 0 included."""
    n = children.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def selected(parents: DataFrame, wanted: list[str], key: str, label: str) -> DataFrame:
    """Parents by id or name; unknown ones raise, sorted."""
    names = list(dict.fromkeys(w.strip() for w in wanted if w.strip()))
    found = parents.filter(F.col(key).cast("string").isin(names) | F.col(label).isin(names))
    got = {str(v) for r in found.select(F.col(key).cast("string"), label).collect() for v in r}  # at most as many as were asked for
    missing = sorted(set(names) - got)
    if missing:
        raise ValueError("unknown: " + ", ".join(missing))
    return found


def hydrated(hits: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    """Hits (id, ord) with their functions and files, in order; unknown ones go."""
    return hits.join(functions, "id").join(files, "file_id")


def consistency(archived: DataFrame) -> DataFrame:
    """One row for each session: messages, distinct events, and whether the sequence has no hole and no double."""
    g = archived.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.countDistinct("event_id").alias("n_events"), F.countDistinct("seq").alias("n_seqs"), F.min("seq").alias("_a"), F.max("seq").alias("_z"))
    return g.select("session_id", "n_messages", "n_events", ((F.col("n_messages") == F.col("n_seqs")) & (F.col("_z") - F.col("_a") + 1 == F.col("n_seqs"))).alias("whole"))


def throughput(done: DataFrame, by: str, seconds: str) -> DataFrame:
    """(by, n, qps): completions over the time from the first to the last; 0 without such a time."""
    span = F.max(seconds) - F.min(seconds)
    return done.groupBy(by).agg(F.count("*").alias("n"), F.round(F.coalesce(F.try_divide(F.count("*"), span), F.lit(0.0)), 6).alias("qps"))


def request_batches(requests: DataFrame, by: list[str], most: int, wait: float) -> DataFrame:
    """requests (.., at seconds) with the number of the batch that takes them: it leaves when full or `wait` after its first."""
    schema = StructType([*requests.schema.fields, StructField("batch", IntegerType())])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple, tuple[int, int, float]] = {}
        for f in frames:
            out = []
            for key, at in zip(f[by].itertuples(index=False, name=None), f["at"], strict=True):
                number, size, first = state.get(key, (0, 0, at))
                if size and (size >= most or at - first > wait):
                    number, size, first = number + 1, 0, at
                state[key] = (number, size + 1, first if size else at)
                out.append(number)
            yield f.assign(batch=pd.Series(out, index=f.index, dtype="int32"))

    # A stream of requests of one key is one sequence; keys (model, task) are few, their streams are read batch by batch.
    return requests.repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by, "at").mapInPandas(fold, schema)


def elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id, label) and edges (caller, callee) as rows of one kind for a graph view."""
    n = nodes.select(F.lit("node").alias("group"), F.col("id").cast("string").alias("id"), F.col("label").alias("label"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"))
    e = edges.select(F.lit("edge").alias("group"), F.concat_ws("->", F.col("caller").cast("string"), F.col("callee").cast("string")).alias("id"), F.lit(None).cast("string").alias("label"), F.col("caller").cast("string").alias("source"), F.col("callee").cast("string").alias("target"))
    return n.unionByName(e)
