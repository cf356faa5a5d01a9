"""Packing by powers of two: each document is cut into pieces of binary lengths, and pieces of one length make a bucket.

A document of n tokens is cut into as many pieces of the greatest length as it fills, and the rest by its binary digits, the longest
first. Every piece is a sequence of its own, so that no sequence crosses documents and none is padded. Pieces of one length are numbered one
after the other, the longest first, and lie together in the files in long stretches, so that a reader of one length skips the pages of the others.

Null or empty texts have the end id alone. Rows of one doc_id, equal rows included, are packed singly and told apart by `row`; null
doc_ids stay null. An empty table gives no rows. Other columns of the input, whatever their names, play no part. Nothing is shuffled:
tasks follow the files of the input, long texts included, and hold some millions of ids for each length.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, scratch_dir, table, tidy
from .token_files import FORMAT, _slices, encoder, tokenizer_path

MOST = 2048
END = 1
#: Ids of one length that are written together.
HELD = 1 << 20
FILES = "doc_id long, row long, start long, length int, doc_tokens long, part int, pos long, ids array<int>"
ROWS_BITS = 33


def powers(most: int) -> np.ndarray:
    """The lengths of pieces, falling; most: a power of two."""
    if most < 1 or most & (most - 1):
        raise ValueError("the greatest length must be a power of two")
    return most >> np.arange(most.bit_length())


def pieces(counts: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of so many tokens, document by document, the longest first."""
    sizes = powers(most)
    each = (counts[:, None] // sizes) & 1
    each[:, 0] = counts // most
    lengths = np.repeat(np.tile(sizes, len(counts)), each.ravel())
    owner = np.repeat(np.arange(len(counts)), each.sum(1))
    ends = np.cumsum(lengths)
    return owner, ends - lengths - (np.cumsum(counts) - counts)[owner], lengths


def packed(docs: DataFrame, tokenizer: str, most: int = MOST, end: int = END) -> DataFrame:
    """The pieces of all documents with their ids; `part` and `pos` (number among the part's pieces of that length) order a bucket."""
    powers(most)
    rows = docs.select("doc_id", "text").withColumn("part", F.spark_partition_id())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, part = encoder(tokenizer), 0, 0
        held: dict[int, list[tuple]] = {}
        written: dict[int, int] = {}

        def out(length: int) -> pa.RecordBatch:
            doc_ids, *numbers, ids = zip(*held.pop(length), strict=True)
            row, start, tokens = (np.concatenate(x) for x in numbers)
            n, at = len(row), written.get(length, 0)
            written[length] = at + n
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="int32") * length), pa.array(np.concatenate(ids)))
            columns = [pa.concat_arrays(doc_ids), row, start, np.full(n, length, "int32"), tokens, np.full(n, part, "int32"), np.arange(at, at + n), lists]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["doc_id", "row", "start", "length", "doc_tokens", "part", "pos", "ids"])

        for whole in batches:
            part = whole.column("part")[0].as_py() if whole.num_rows else part
            for b in _slices(whole, "text"):
                flat, counts = model.encode(b.column("text").to_pylist(), end)
                owner, start, lengths = pieces(counts, most)
                at = np.cumsum(lengths) - lengths
                for length in np.unique(lengths).tolist():
                    some = np.flatnonzero(lengths == length)
                    own = owner[some]
                    places = (at[some][:, None] + np.arange(length)).ravel()
                    held.setdefault(length, []).append((b.column("doc_id").take(pa.array(own)), (part << ROWS_BITS) + seen + own, start[some], counts[own], flat[places]))
                    if sum(len(x[-1]) for x in held[length]) >= HELD:
                        yield out(length)
                seen += b.num_rows
        for length in sorted(held, reverse=True):
            yield out(length)

    return rows.mapInArrow(tidy(each), FILES)


def write_packed(docs: DataFrame, tokenizer: str, path: str, most: int = MOST, end: int = END) -> None:
    packed(docs, tokenizer, most, end).write.options(**FORMAT).parquet(path)


def read_packed(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """The pieces in the files; with a length, those of one bucket, others' row groups and pages being skipped."""
    rows = spark.read.schema(FILES).parquet(path)
    return rows if length is None else rows.filter(F.col("length") == length)


def numbered(rows: DataFrame, most: int = MOST) -> DataFrame:
    """rows with sequence_id, gapless over all rows, longer pieces first, and offset in the sequence. The driver gets a row of counts for each part."""
    sizes = powers(most).tolist()
    counts = [F.count_if(F.col("length") == n).alias(f"n{n}") for n in sizes]
    parts = rows.groupBy("part").agg(*counts).orderBy("part").collect()
    n = np.array([[r[f"n{s}"] for s in sizes] for r in parts], "int64").reshape(len(parts), len(sizes)).T
    before = (np.cumsum(n) - n.ravel()).reshape(n.shape).T.tolist()
    bases = rows.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(parts, before, strict=True)], "part int, _before array<long>")
    place = F.get("_before", F.array_position(F.array(*[F.lit(s) for s in sizes]), F.col("length").cast("int")).cast("int") - 1)
    return rows.join(bases, "part").withColumn("sequence_id", place + F.col("pos")).withColumn("offset", F.lit(0).cast("long")).drop("_before")


def digests(files: DataFrame) -> DataFrame:
    """The rows of the files with the checksum of their ids instead of the ids."""
    kept = [c for c in files.columns if c != "ids"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            bounds = ids.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            crc = [zlib.crc32(values[4 * s : 4 * e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(crc, "int64")], names=[*kept, "ids_crc32"])

    return files.mapInArrow(tidy(digest), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema if f.name != "ids") + ", ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    write_packed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), out)
    narrow = cut(digests(read_packed(spark, out)))
    discard(spark, out)
    return numbered(narrow).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset", "row")
