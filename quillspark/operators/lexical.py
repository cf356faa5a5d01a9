"""BM25: inverted index, corpus statistics and top-k by question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens

K1, B = 1.5, 0.75


#: Distinct tokens of questions up to which they are broadcast.
FEW = 200_000


def asked_tokens(questions: DataFrame, asked: str) -> DataFrame:
    """(asked, token, qf) of each question."""
    return questions.select(asked, F.explode(lexical_tokens(F.col("text"))).alias("token")).groupBy(asked, "token").agg(F.count("*").alias("qf"))


def postings(docs: DataFrame, key: str, text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(key, token, tf, dl); documents without tokens are left out. only: the tokens that are wanted, before anything is shuffled."""
    tokens = docs.select(key, lexical_tokens(F.col(text)).alias("tokens"))
    flat = tokens.select(key, F.size("tokens").alias("dl"), F.explode("tokens").alias("token"))
    if only is not None:
        flat = flat.join(F.broadcast(only) if only.count() <= FEW else only, "token", "left_semi")
    return flat.groupBy(key, "dl", "token").agg(F.count("*").alias("tf"))


def statistics(index: DataFrame, key: str) -> DataFrame:
    """One row: documents and their mean length."""
    return index.select(key, "dl").distinct().agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def corpus_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same from the documents themselves: one pass without a shuffle of tokens."""
    return docs.select(F.size(lexical_tokens(F.col(text))).alias("dl")).filter("dl > 0").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("df"))


def scores(index: DataFrame, questions: DataFrame, key: str, asked: str, k1: float = K1, b: float = B, stats: DataFrame | None = None) -> DataFrame:
    """(asked, key, score): the sum over question tokens, repeats counted, rounded so that ties are ties. stats: those of the corpus, if known."""
    stats = (statistics(index, key) if stats is None else stats).first()  # one row
    n, mean = stats["n_docs"], stats["avgdl"] or 1.0
    terms = asked_tokens(questions, asked)
    wanted = index.join(terms.select("token").distinct(), "token", "left_semi")
    df = document_frequency(wanted)
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean))
    hits = wanted.join(df, "token").select("token", key, weight.alias("w")).join(terms, "token")
    return hits.groupBy(asked, key).agg(F.round(F.sum(F.col("w") * F.col("qf")), 9).alias("score")).filter("score > 0")


def top(rows: DataFrame, by: str, score: str, tie: str, k: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
