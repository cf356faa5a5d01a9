"""Reciprocal-rank fusion, degradation and batched reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A fixed value.
RANK_CONSTANT = 60


def fused(vector: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Both lists (query_id, source, chunk_id, score, rank) by summed reciprocal ranks; ties as the order below says."""
    keys = ["query_id", "source", "chunk_id"]
    v = vector.select(*keys, F.col("score").alias("vector_score"), F.col("rank").alias("vr"))
    b = lexical.select(*keys, F.col("score").alias("bm25_score"), F.col("rank").alias("br"))
    part = lambda c: F.coalesce(1 / (F.lit(float(RANK_CONSTANT)) + F.col(c)), F.lit(0.0))
    rows = v.join(b, keys, "full_outer").withColumn("rrf_score", F.round(part("vr") + part("br"), 9))
    label = F.when(F.col("vr").isNotNull() & F.col("br").isNotNull(), "hybrid").when(F.col("vr").isNotNull(), "vector").otherwise("bm25")
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.desc_nulls_last("vector_score"), F.desc_nulls_last("bm25_score"), F.desc("source"), F.asc("chunk_id"))
    return rows.withColumn("retrieval_source", label).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, k)).drop("vr", "br")


def degraded(vector: DataFrame, lexical: DataFrame, k: int, bm25_ok: bool, vector_ok: bool, healthy: bool = True) -> DataFrame:
    """What recall returns when a branch fails: only one list, cut to k except where the vector branch failed at run time."""
    if not bm25_ok and not vector_ok:
        raise RuntimeError("both recall branches failed")
    if bm25_ok and vector_ok and healthy:
        return fused(vector, lexical, k)
    rows, name = (vector, "vector") if not bm25_ok and healthy else (lexical, "bm25")
    rows = rows if (vector_ok is False and healthy) else rows.filter(F.col("rank") <= k)
    return rows.select("query_id", "source", "chunk_id", "score", "rank", F.lit(name).alias("retrieval_source"))


def rerank_text(source: Column, headings: Column, kind: Column, text: Column) -> Column:
    part = lambda label, c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(label), c))
    return F.concat_ws("\n", part("Source: ", source), part("Headings: ", F.array_join(headings, " > ")), part("Content type: ", kind), part("", text))


def reranked(candidates: DataFrame, scorer: Column, k: int, batch: int = 64) -> DataFrame:
    """Candidates by rerank_score over all batches, stable in their first order. scorer stands for the model."""
    rows = candidates.withColumn("batch", F.floor((F.col("rank") - 1) / batch).cast("int")).withColumn("rerank_score", F.round(scorer, 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= max(1, k))


def from_replies(candidates: DataFrame, replies: DataFrame, k: int, batch: int = 64) -> DataFrame:
    """Candidates as a model's replies order them, with rerank_score and new_rank; the k first of each question.

    candidates: query_id, rank from 1 on without gaps; replies: query_id, batch (which `batch` candidates it is about, from 0 on), results, an
    array of (index in the batch, relevance_score). A question with one batch keeps the order of its reply; of several, scores decide, ties as
    they came. An index beyond the question's candidates, or a result without index or score, is an error; what a reply leaves out is left out.
    """
    n = Window.partitionBy("query_id")
    rows = candidates.withColumn("_n", F.count("*").over(n))
    told = replies.select("query_id", "batch", F.posexplode("results").alias("_pos", "_r")).withColumn("_at", F.col("_r.index") + F.col("batch") * batch)
    sizes = rows.groupBy("query_id").agg(F.max("_n").alias("_size"))
    told = told.join(sizes, "query_id", "left")
    broken = F.col("_r.index").isNull() | F.col("_r.relevance_score").isNull()
    beyond = (F.col("_at") < 0) | F.col("_size").isNull() | (F.col("_at") >= F.col("_size"))
    rank = F.when(broken, F.raise_error(F.lit("a result has no index or score"))).when(beyond, F.raise_error(F.lit("a result's index is out of range"))).otherwise(F.col("_at") + 1).cast("int")
    told = told.select("query_id", rank.alias("rank"), F.col("_r.relevance_score").alias("rerank_score"), F.col("batch").alias("_b"), "_pos")
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("_n") > batch, -F.col("rerank_score")), "_b", "_pos")
    found = rows.join(told, ["query_id", "rank"]).withColumn("new_rank", F.row_number().over(order))
    return found.filter(F.col("new_rank") <= max(1, k)).drop("_n", "_b", "_pos")
