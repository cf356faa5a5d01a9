"""Token ids as Parquet list columns, in document order, and their reading.

Documents are dealt into runs by ranges of doc_id, encoded run by run, and written as one file a run with dictionary-coded ids,
bounded row groups and page indexes, so that a reader of few documents or of the metadata columns alone touches few
pages. Reading back yields counts, offsets and checksums.

The library encodes all texts. Where a tokenizer's own steps (its file tells them) cannot reach across the start of a run of white
space, texts are cut there, each distinct unit is encoded once among others, and ids of units are remembered; other tokenizers get
whole texts.

Null or empty texts have the end id alone. Null doc_ids come last. Rows of one doc_id are ordered by a hash of the text, then
by text. An empty table gives no rows. Other columns of the input play no part.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, scratch_dir, spans, table, tidy

END = 2
#: Text bytes in one file, more or less.
RUN_BYTES = 32 << 20
#: Units of text whose ids a worker remembers (some 40 bytes each), bytes of the longest such, and how many stand in one text.
REMEMBERED, LONGEST, TOGETHER = 800_000, 48, 256
FORMAT = {"parquet.enable.dictionary": "true", "parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "compression": "snappy"}

U = np.uint64
_loaded: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts_at_spaces(made: dict) -> bool:
    """Whether a tokenizer (its file's content) encodes `a` and ` b` apart as it does in `a b`, where a ends in no white space.

    Its added tokens must hold and strip no white space, its normaliser work on characters or on runs of white space, and its first
    splitting leave no piece that goes on past a character other than white space into white space.
    """

    def flat(step: dict | None, inner: str) -> list[dict]:
        return [] if step is None else [x for y in step[inner] for x in flat(y, inner)] if step["type"] == "Sequence" else [step]

    for t in made.get("added_tokens") or []:
        if re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
            return False
    for step in flat(made.get("normalizer"), "normalizers"):
        runs = step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "
        if not runs and step["type"] not in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase"):
            return False
    steps = flat(made.get("pre_tokenizer"), "pretokenizers")
    if not steps:
        return False
    one, rest = steps[0], steps[1:]
    if one["type"] == "Split" and one["behavior"] == "Removed" and one["invert"] and "Regex" in one["pattern"]:
        # Classes that exclude white space aside, the pattern must name none and no complement that could hold some.
        left = re.sub(r"\[\^[^\]]*\\s[^\]]*\]", "", one["pattern"]["Regex"])
        safe = not re.search(r"[\s.]|\[\^|\\[sSWDP]", left)
    else:
        safe = one["type"] in ("WhitespaceSplit", "Whitespace") or one["type"] == "ByteLevel" and one.get("use_regex", True) and not one["add_prefix_space"]
    return safe and all(x["type"] == "ByteLevel" and not x.get("use_regex", True) and not x["add_prefix_space"] for x in rest)


class Memory:
    """Ids of units of text, found by hash and compared byte by byte."""

    def __init__(self):
        self.hashes = np.empty(0, "uint64")
        self.at, self.size, self.ids_at, self.count = (np.empty(0, "int32") for _ in range(4))
        self.text, self.ids = np.empty(0, "uint8"), np.empty(0, "int32")

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where each unit is, -1 where it is not known."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        where = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        where[(self.hashes[where] != hashes) | (self.size[where] != sizes)] = -1
        hit = np.flatnonzero(where >= 0)
        differ = data[spans(starts[hit], sizes[hit])] != self.text[spans(self.at[where[hit]], sizes[hit])]
        if differ.any():  # of one hash, but others
            where[hit[np.unique(np.repeat(np.arange(len(hit)), sizes[hit])[differ])]] = -1
        return where

    def add(self, hashes: np.ndarray, text: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        every = np.r_[self.hashes, hashes]
        order = every.argsort(kind="stable")
        self.hashes = every[order]
        for name, more in (("at", len(self.text) + np.cumsum(sizes) - sizes), ("size", sizes), ("ids_at", len(self.ids) + np.cumsum(counts) - counts), ("count", counts)):
            setattr(self, name, np.r_[getattr(self, name), more.astype("int32")][order])
        self.text, self.ids = np.r_[self.text, text], np.r_[self.ids, ids]


class Encoder:
    """Ids of texts by the tokenizers library, unit by unit."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.apart = cuts_at_spaces(json.loads(self.tokenizer.to_str()))
        self.known = Memory()
        self.values = np.random.default_rng(11).integers(1 << 62, 1 << 63, 256).astype("uint64") * U(2) + U(1)
        self.powers = np.cumprod(np.r_[U(1), np.full(LONGEST, 0x9E3779B97F4A7C55, "uint64")], dtype="uint64")

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and their counts."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "int32"), np.array([len(i) for i in found], "int64")

    def joined(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of units that begin with white space and end in none: many in one text, told apart by the places of their tokens."""
        raw, ends = text.tobytes(), np.cumsum(sizes)
        chars = np.add.reduceat((text & 0xC0) != 0x80, ends - sizes, dtype="int64") if len(sizes) else sizes
        ids, counts = [np.empty(0, "int32")], [np.empty(0, "int64")]
        for at in range(0, len(sizes), TOGETHER * 64):
            bounds = [*range(at, min(at + TOGETHER * 64, len(sizes)), TOGETHER), min(at + TOGETHER * 64, len(sizes))]
            groups = [raw[ends[a] - sizes[a] : ends[b - 1]].decode("utf-8", "surrogatepass") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for a, b, found in zip(bounds[:-1], bounds[1:], self.tokenizer.encode_batch(groups, add_special_tokens=False), strict=True):
                owner = np.searchsorted(np.cumsum(chars[a:b]), np.fromiter([x for x, _ in found.offsets], "int64"), side="right")
                if (np.diff(owner) < 0).any():
                    some, each = self.whole([raw[ends[k] - sizes[k] : ends[k]].decode("utf-8", "surrogatepass") for k in range(a, b)])
                else:
                    some, each = np.array(found.ids, "int32"), np.bincount(owner, minlength=b - a)
                ids.append(some)
                counts.append(each)
        return np.concatenate(ids), np.concatenate(counts)

    def units(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct units, one after the other, and their counts. open_: units that cannot stand among others."""
        where = self.known.find(hashes, data, starts, sizes)
        counts = np.where(where >= 0, self.known.count[where], 0) if len(self.known.count) else np.zeros(len(where), "int64")
        old, alone, among = where >= 0, np.flatnonzero((where < 0) & open_), np.flatnonzero((where < 0) & ~open_)
        one, counts[alone] = self.whole([data[a : a + n].tobytes().decode("utf-8", "surrogatepass") for a, n in zip(starts[alone].tolist(), sizes[alone].tolist(), strict=True)])
        text = data[spans(starts[among], sizes[among])]
        two, counts[among] = self.joined(text, sizes[among])
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), "int32")
        out[spans(at[old], counts[old])] = self.known.ids[spans(self.known.ids_at[where[old]], counts[old])]
        out[spans(at[alone], counts[alone])], out[spans(at[among], counts[among])] = one, two
        keep = sizes[among] <= LONGEST
        if len(self.known.hashes) + keep.sum() <= REMEMBERED:
            self.known.add(hashes[among][keep], text[np.repeat(keep, sizes[among])], sizes[among][keep], two[np.repeat(keep, counts[among])], counts[among][keep])
        return out, counts

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, each with the end id, and their counts."""
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        length = np.array([len(r) for r in raw], "int64")
        data = np.frombuffer(b"".join(raw), "uint8")
        if not self.apart or not len(data):
            counts = np.zeros(len(texts), "int64")
            flat, counts[length > 0] = self.whole([t for t in texts if t])
        else:
            docs = np.cumsum(length) - length
            space = (data == 0x20) | ((data >= 9) & (data <= 13))
            # A visible ASCII character, or one of two bytes that is not white space.
            visible = (data > 0x20) & (data < 0x7F)
            visible[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
            starts = np.r_[True, space[1:] & visible[:-1]]
            starts[docs[length > 0]] = True
            starts = np.flatnonzero(starts)
            sizes = np.diff(np.r_[starts, len(data)])
            hashes, first, inverse = self._distinct(data, starts, sizes)
            open_ = ~(space[starts[first]] & visible[starts[first] + sizes[first] - 1])
            ids, each = self.units(hashes, data, starts[first], sizes[first], open_)
            own = each[inverse]
            flat = ids[spans((np.cumsum(each) - each)[inverse], own)]
            counts = np.diff(np.r_[0, np.cumsum(own)][np.searchsorted(starts, np.r_[docs, len(data)])])
        out = np.full(len(flat) + len(texts), end, "<i4")
        out[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), counts)] = flat
        return out, counts + 1

    def _distinct(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and numbers of units that stand for all equal ones, and for each unit which of these it is; long units stand for themselves."""
        place = np.minimum(np.arange(len(data)) - np.repeat(starts, sizes), LONGEST)
        hashes = np.add.reduceat(self.values[data] * self.powers[place], starts)
        short = np.flatnonzero(sizes <= LONGEST)
        _, first, inverse = np.unique(hashes[short], return_index=True, return_inverse=True)
        first = short[first]
        like = first[inverse]
        if (sizes[like] != sizes[short]).any() or (data[spans(starts[short], sizes[short])] != data[spans(starts[like], sizes[like])]).any():
            first = every = np.arange(len(starts))  # two of one hash: each stands for itself
        else:
            long, every = np.flatnonzero(sizes > LONGEST), np.empty(len(starts), "int64")
            every[short], every[long] = inverse, len(first) + np.arange(len(long))
            first = np.r_[first, long]
        return hashes[first], first, every


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _slices(batch: pa.RecordBatch, column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about 2 MB of text each; a longer text comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, run, pos (row number in the run) and ids of each document; runs are partitions in ascending doc_id order."""
    runs = max(1, -(-(docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0) // RUN_BYTES))
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text").asc()]  # the hash parts the rows of one doc_id
    dealt = docs.select("doc_id", "text").repartitionByRange(runs, *order)
    rows = dealt.sortWithinPartitions(*order, F.asc_nulls_first("text")).withColumn("run", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pos = encoder(path), 0
        for whole in batches:
            for b in _slices(whole, "text"):
                flat, counts = model.encode(b.column("text").to_pylist(), end)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype("int32")), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("run"), pa.array(np.arange(pos, pos + b.num_rows)), lists], names=["doc_id", "run", "pos", "ids"])
                pos += b.num_rows

    return rows.mapInArrow(tidy(encode), "doc_id long, run int, pos long, ids array<int>")


def write_ids(docs: DataFrame, tokenizer: str, out: str, end: int = END) -> None:
    encoded(docs, tokenizer, end).write.options(**FORMAT).parquet(out)


def read_ids(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, run, pos, ids of the files; a doc_id range is pushed down to row groups and pages."""
    rows = spark.read.schema("doc_id long, run int, pos long, ids array<int>").parquet(path)
    rows = rows.filter(F.col("doc_id") >= low) if low is not None else rows
    return rows.filter(F.col("doc_id") <= high) if high is not None else rows


def digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row of the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            bounds = ids.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            crc = [zlib.crc32(values[4 * s : 4 * e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("run"), b.column("pos"), pa.array(np.diff(bounds).astype("int64")), pa.array(crc, "int64")], names=["doc_id", "run", "pos", "n_tokens", "ids_crc32"])

    narrow = cut(files.mapInArrow(tidy(digest), "doc_id long, run int, pos long, n_tokens long, ids_crc32 long"))
    total, rows = 0, []
    for r in narrow.groupBy("run").agg(F.sum("n_tokens").alias("t")).orderBy("run").collect():  # a row for each file
        rows.append((r["run"], total))
        total += r["t"]
    before = F.broadcast(files.sparkSession.createDataFrame(rows, "run int, _before long"))
    earlier = Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # runs hold some MB of text each
    start = F.col("_before") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))
    return narrow.join(before, "run").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", "run", "pos")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), tokenizer_path(), out)
    found = digests(read_ids(spark, out))  # has read the ids
    discard(spark, out)
    return found
