"""From raw documents to mixed, tokenised training data: STAGES in order, each over all that the one before kept.

All stages take documents (doc_id, text, source, whatever other columns of any name) and keep these columns; an empty table stays
empty, extra columns go along with their rows. What a stage does with nulls, ties and repeated rows, its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import mixing, nbest_pieces, rule_ensemble, shingle_join, suffix_dedup
from quillspark.llm.common import cut, drop, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject. Null and empty texts are scored as texts without words; equal rows fare alike."""
    return rule_ensemble.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8 or more: that of the least doc_id, rows without one last, the first of equal rows. Null and empty texts link with nothing and stay."""
    return shingle_join.distinct_documents(docs, 5, 80, 100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document of smaller id has. Null texts become empty; a null doc_id counts as the largest; rows of one doc_id leave one another alone."""
    return suffix_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. Null sources are one source; texts without words, and null ones, stay once; equal rows share their copies."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document's best segmentation, and the scores of the N best, a row for each row. Null and empty texts have no ids."""
    return nbest_pieces.segmented(docs, nbest_pieces.model_path(), ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("tokens", tokens)]

#: Fitted models and graph components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
