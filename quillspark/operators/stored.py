"""A BM25 index that is built once for each state of its corpus and then read by version."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, stored
from ..sources.snapshots import Snapshots
from . import lexical, postings

Corpus = Callable[[], DataFrame]


class StoredIndex:
    """Blocks of postings with their bounds in folders by token, frequencies and one row of statistics, as versions of a store. Searches read the folders of their tokens only, and of blocks that cannot matter only the bounds."""

    def __init__(self, store: Snapshots, key: str, text: str = "text", buckets: int = 64, window: int = postings.NARROW):
        self.store, self.key, self.text, self.buckets, self.window = store, key, text, buckets, window

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.hash(token), F.lit(self.buckets))

    def _config(self, signature: str) -> dict:
        return {"signature": signature, "key": self.key, "text": self.text, "buckets": self.buckets, "window": self.window}

    def ensure(self, corpora: list[Corpus], signature: Callable[[], str]) -> str:
        """The active version; built anew only where the signature is another."""
        if self.store.is_current(self._config(signature())):
            return self.store.active()
        return self.rebuild(corpora, signature)

    def rebuild(self, corpora: list[Corpus], signature: Callable[[], str], expected: str | None = None) -> str:
        """Builds from the first corpus that can be read, and switches to it. Fails, and leaves the active version as it is, where the
        corpus changes meanwhile or another version than `expected` is active."""
        before, version = signature(), f"bm25-{uuid.uuid4().hex}"
        self.store.prepare(version)
        try:
            self._build(version, corpora, before)
            if signature() != before:
                raise RuntimeError("the corpus changed while its index was built")
            self.store.activate(version, expected)
        except BaseException:
            self.store.discard(version)
            raise
        return version

    def _build(self, version: str, corpora: list[Corpus], signature: str) -> None:
        for n, corpus in enumerate(corpora, 1):
            try:
                made = stored(postings.blocks(corpus(), self.key, self.text, size=self.window), "blocks")
            except (AnalysisException, OSError):  # a corpus that is not there or cannot be read; the last one's reason is raised
                if n == len(corpora):
                    raise
                continue
            docs, mean = postings.statistics(made)
            bucket = self._bucket(F.col("token"))
            # What follows from a block's lists, and what is the same in all blocks, is added after the shuffle.
            dealt = made.filter("token is not null").select("window", "token", "keys", "tf", "dl", bucket.alias("bucket")).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "token", "window")
            blocks = postings.bounded(dealt, mean).select("window", F.lit(True).alias("wanted"), "token", F.size("keys").cast("long").alias("n"), F.lit(0).cast("long").alias("total"), "keys", "tf", "dl", "most", "bucket")
            tables = {
                "blocks": blocks,
                "terms": postings.frequencies(made).withColumn("bucket", bucket).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "token"),
                "stats": self.store.spark.createDataFrame([(docs, mean, n)], "n_docs long, avgdl double, corpus int"),
            }
            self.store.build(version, tables, self._config(signature), by={"blocks": "bucket", "terms": "bucket"})
            return drop(made)

    def _asked(self, version: str, questions: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame, tuple]:
        """(terms of the questions, their blocks, their frequencies, statistics); only folders of asked tokens are read."""
        asked = stored(lexical.asked_tokens(questions, name), "asked")
        wanted = [r["b"] for r in asked.select(self._bucket(F.col("token")).alias("b")).distinct().collect()]  # at most as many as there are buckets
        blocks, terms = (self.store.table(t, version).filter(F.col("bucket").isin(wanted)).drop("bucket") for t in ("blocks", "terms"))
        stats = self.store.table("stats", version).first()
        return asked, blocks, terms, (stats["n_docs"], stats["avgdl"])

    def search(self, questions: DataFrame, asked: str, k: int) -> DataFrame:
        """(asked, key, score, rank) of the k best of each question by the active version, resolved once: rows as a search through all postings gives them."""
        terms, blocks, df, stats = self._asked(self.store.active(), questions, asked)
        scratch = [terms]

        def keep(rows: DataFrame) -> DataFrame:
            scratch.append(stored(rows, "search"))
            return scratch[-1]

        found = stored(postings.best(blocks, terms, asked, k, *stats, df, keep), "found")
        drop(*scratch)
        return found.withColumnRenamed("key", self.key)

    def blocks_read(self, questions: DataFrame, asked: str, k: int) -> tuple[int, int]:
        """(blocks whose postings a search scores, blocks of asked tokens)."""
        terms, blocks, df, (n, mean) = self._asked(self.store.active(), questions, asked)
        read = every = 0
        for lot in postings.terms(terms, asked, df, n):
            kinds = dict(terms.dtypes)[asked], blocks.schema["keys"].dataType.elementType.simpleString()
            limits = stored(postings.placed(postings.bounds(blocks, lot)))
            first = limits.filter(F.col("place") <= postings.FIRST)
            one = stored(postings.scored(blocks, lot, asked, kinds, mean, k, first))
            pairs = first.select("window", "q").unionByName(postings.needed(limits, one, lot, asked, k))
            own = postings.asked_blocks(blocks, lot).select("window", "token")
            every += own.count()
            read += own.join(pairs.select("window").distinct(), "window", "left_semi").count()
        return read, every
