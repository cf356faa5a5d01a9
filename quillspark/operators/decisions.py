"""The route of a question by all steps: phrases and state, then the nearer anchors, then a model's reply, then retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models, routing
from .vector_cache import VectorCache
from .vectors import anchor_route


def decided(questions: DataFrame, key: str, anchors: DataFrame, cache: VectorCache, load: Callable[[], models.Encoder], model: str, domain: list[str], rag_least: float = 0.38, direct_least: float = 0.40, margin: float = 0.06) -> DataFrame:
    """(key, route, use_rag). Only questions that no phrase and no state decide are encoded, and anchors and texts that were encoded before are not encoded again.

    questions: key (unique), question, text (what is encoded), used_rag, had_contexts, reply (a model's, null where it was not asked or
    failed); anchors: kind (rag or direct), text. Without anchors of both kinds the step of the anchors says nothing.
    """
    first = questions.withColumn("route", routing.route(F.col("question"), F.col("used_rag"), F.col("had_contexts"), domain))
    open_ = first.filter("route = 'fallback_rag'").select(key, "text")
    encoded = lambda rows: cache.encoded(rows, "text", load, model)
    known = encoded(anchors.select("kind", "text").distinct()).select("kind", F.col("text").alias("anchor_id"), F.col("embedding").alias("v"))
    of = lambda kind: known.filter(F.col("kind") == kind).select("anchor_id", "v")
    near = anchor_route(encoded(open_).select(F.col(key).alias("vec_id"), F.col("embedding").alias("v")), of("rag"), of("direct"), rag_least, direct_least, margin)
    said = near.filter("route <> 'none'").select(F.col("vec_id").alias(key), F.concat(F.lit("embedding_"), "route").alias("_by_anchor"))
    rows = first.join(said, key, "left")
    route = F.when(F.col("route") != "fallback_rag", F.col("route")).otherwise(F.coalesce("_by_anchor", models.model_route(F.col("reply")), F.lit("fallback_rag")))
    return rows.select(key, route.alias("route")).withColumn("use_rag", ~F.col("route").endswith("direct"))
