"""Code search from end to end, its fallback without vectors, retrieval with failing parts, and what answers show of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from . import fusion
from .code import lexical_boost, path_penalty
from .lexical import top
from .vectors import nearest

#: Hits that a code answer shows, and characters of each.
SHOWN, CUT = 8, 2400


def point_vector(value: Column, keys: tuple[str, ...] = ("", "default", "vector", "embedding")) -> Column:
    """The vector of a map of named vectors: by the known names, else the only entry, else empty."""
    known = F.coalesce(*[F.element_at(value, F.lit(k)) for k in keys])
    only = F.when(F.size(value) == 1, F.get(F.map_values(value), F.lit(0)))
    return F.coalesce(known, only, F.array().cast("array<double>"))


def missing_tables(there: list[str], needed: list[str]) -> list[str]:
    """Raises with the names of the tables an index lacks; both must exist."""
    lost = [n for n in needed if n not in there]
    if lost:
        raise LookupError("missing: " + ", ".join(sorted(lost)))
    return needed


def best_of(hits: DataFrame, by: list[str]) -> DataFrame:
    """The best score of each key."""
    return hits.groupBy(*by).agg(F.max("score").alias("score"))


def file_hits(files: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, file_id, score): the files nearest to each question. files: file_id, v; questions: query_id, v."""
    near = nearest(files.select(F.col("file_id").alias("vec_id"), "v").filter("vec_id is not null"), questions, k=k)
    return top(near, "query_id", "score", "vec_id", k).select("query_id", F.col("vec_id").alias("file_id"), "score")


def in_files(functions: DataFrame, questions: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) of the best functions in a question's files; no files, no functions. functions: id, file_id, v."""
    rows = functions.select(F.col("id").alias("vec_id"), "v", F.col("file_id").alias("grp"))
    near = nearest(rows, questions, k=k, allowed=files.select("query_id", F.col("file_id").alias("grp")))
    return top(near, "query_id", "score", "vec_id", k).select("query_id", F.col("vec_id").alias("id"), "score")


def code_search(functions: DataFrame, files: DataFrame, questions: DataFrame, lexical: DataFrame, tokens: Column, file_top: int = 20, function_top: int = 50, final: int = 10) -> DataFrame:
    """(query_id, rank, id, final_score): functions in the nearest files, functions anywhere and lexical candidates, by vector and words.

    functions: id, file_id, v and the columns that lexical_boost reads; files: file_id, v; questions: query_id, v; lexical: ids of
    candidates, whose lexical scores do not count. A question without file hits finds nothing.
    """
    chosen = file_hits(files, questions, file_top)
    rows, most = functions.select(F.col("id").alias("vec_id"), "v"), max(50, 10 * final)
    wide = top(nearest(rows, questions, k=most), "query_id", "score", "vec_id", most)
    words = nearest(rows.join(lexical.select(F.col("id").alias("vec_id")).distinct(), "vec_id", "left_semi"), questions)  # as many as there are candidates
    both = wide.select("query_id", F.col("vec_id").alias("id"), "score").unionByName(words.withColumnRenamed("vec_id", "id"))
    every = in_files(functions, questions, chosen, function_top).unionByName(both)
    every = every.join(chosen.select("query_id").distinct(), "query_id", "left_semi")
    hits = best_of(every, ["query_id", "id"]).join(functions.drop("v"), "id").withColumn("final_score", F.round(F.col("score") + lexical_boost(tokens), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc("score"), path_penalty(F.col("path")) > 0, "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= final).select("query_id", "rank", "id", "final_score")


def text_only(functions: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """(kind, rank, id, score, retrieval_degraded, embedding_degraded): lexical hits where no embedding can be had. Both: id, score."""
    rows = None
    for kind, df in (("function", functions), ("file", files)):
        one = top(df.withColumn("kind", F.lit(kind)), "kind", "score", "id", k).select("kind", "rank", F.col("id").cast("string").alias("id"), "score")
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("retrieval_degraded", F.lit(True)).withColumn("embedding_degraded", F.lit(True))


FLAGS = ["retrieval_degraded", "embedding_degraded", "qdrant_degraded", "reranker_degraded", "bm25_degraded"]


def retrieve(vector: DataFrame, lexical: DataFrame, recall_k: int, final_k: int, scorer: Column | None, *, bm25_ok: bool = True, vector_ok: bool = True, embedding_healthy: bool = True, store_healthy: bool = True, reranker_healthy: bool = True) -> DataFrame:
    """Recall and reranking of each question with failing parts, as rows with rank, score and five flags.

    Unhealthy embedding or store: the lexical list, cut. A vector branch that fails at run time: the lexical list, uncut. A lexical
    branch that fails: the vector list, cut. Both: an error. Without a reranker, or with an unhealthy one, recall is cut to final_k.
    scorer: the reranker's score over the recalled rows, None where there is none.
    """
    healthy = embedding_healthy and store_healthy
    if healthy and vector_ok and bm25_ok:
        recalled = fusion.fused(vector, lexical, recall_k).withColumn("score", F.col("rrf_score"))
        recalled = recalled.select("query_id", "source", "chunk_id", "score", "rank", "retrieval_source")
    else:
        recalled = fusion.degraded(vector, lexical, recall_k, bm25_ok, vector_ok and healthy, healthy)
    recall_bad = not (healthy and vector_ok and bm25_ok)
    use = scorer is not None and reranker_healthy
    if use:
        out = fusion.reranked(recalled, scorer, final_k).select("query_id", "source", "chunk_id", F.col("rerank_score").alias("score"), F.col("new_rank").alias("rank"), "retrieval_source")
    else:
        out = recalled.filter(F.col("rank") <= final_k)
    reranker_bad = scorer is not None and not reranker_healthy
    flags = [recall_bad or reranker_bad, not embedding_healthy, not store_healthy or (healthy and not vector_ok), reranker_bad, False]
    return out.withColumns({n: F.lit(f) for n, f in zip(FLAGS[:4], flags[:4], strict=True)})


def limited(text: Column, most: int) -> Column:
    """A text cut at `most` characters, without the blanks that then end it."""
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.substring(text, 1, most), r"\s+$", ""))


def result_of(repository: Column, path: Column, signature: Column, docstring: Column, snippet: Column) -> tuple[Column, Column]:
    """(source, text) that an answer shows of a code hit."""
    some = F.filter(F.array(signature, docstring, snippet), lambda x: strip(F.coalesce(x, F.lit(""))) != "")
    return F.concat(repository, F.lit("/"), path), F.array_join(some, "\n\n")


def snippet(text: Column, start: Column, lines: int = 10) -> Column:
    """The first lines of a text from line `start` (1 is the first)."""
    return F.array_join(F.slice(F.split(text, "\n"), F.greatest(start, F.lit(1)), F.lit(lines)), "\n")


def answer_list(hits: DataFrame, by: str, text: Column, label: Column) -> DataFrame:
    """(by, prompt): the first hits, each numbered, cut and parted by lines of three dashes. hits: rank."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), label, F.lit("\n"), limited(text, CUT))
    rows = hits.filter(F.col("rank") <= SHOWN).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("m"))
    return rows.select(by, F.array_join(F.transform("m", lambda x: x["line"]), "\n\n---\n\n").alias("prompt"))


def embedding_text(parts: dict[str, Column], most: int) -> Column:
    """Labelled parts that are not blank, parted by blank lines, cut to `most` characters."""
    one = lambda k, c: F.when(strip(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{k}: "), c))
    return limited(F.concat_ws("\n\n", *[one(k, c) for k, c in parts.items()]), most)


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """The mean of token vectors where the mask is 1 (of at least 1e-9 of them), as a unit vector."""
    kept = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    zero = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / n)
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(mean, lambda x: x / norm)).otherwise(mean)


def target_hit(found: Column, target: Column) -> Column:
    """Whether a found name is the target, ends in it after a separator, or, for dotted targets, ends in it or bears its last part alone."""
    last = F.element_at(F.split(target, r"\."), -1)
    ends = found.endswith(F.concat(F.lit("."), target)) | found.endswith(F.concat(F.lit("::"), target))
    return (found == target) | ends | (F.contains(target, F.lit(".")) & (found.endswith(target) | (found == last)))


def code_recall(ranked: DataFrame, cases: DataFrame, k: int, single: int) -> DataFrame:
    """One row: recall@k over all cases, the first `single` and the rest. ranked: idx, rank, name; cases: idx, targets."""
    hits = cases.join(ranked.filter(F.col("rank") <= k), "idx", "left").withColumn("_hit", F.exists("targets", lambda t: F.coalesce(target_hit(F.col("name"), t), F.lit(False))))
    per = hits.groupBy("idx").agg(F.max(F.col("_hit").cast("int")).alias("hit"))
    part = lambda c: F.round(F.coalesce(F.avg(F.when(c, F.col("hit"))), F.lit(0.0)), 6)
    return per.agg(F.count("*").alias("n"), part(F.lit(True)).alias("recall"), part(F.col("idx") < single).alias("single"), part(F.col("idx") >= single).alias("ambiguous"))
