"""WARC files, and the audit of replicas by Merkle trees.

Pages are written as gzipped WARC files of bounded size in page order, each replica a set of files. An index is made from the files
themselves: each replica's records with their own byte ranges, found by their lengths, and after a damaged head or a wrong length
by the next record's beginning. A tree stands over the records of each file in the order of offsets: a leaf hashes a
record's bytes, a node its children. Nodes end at records whose id hashes to a multiple of the fan (of its square on the second
level, and so on), so that a lost, longer or shorter record changes the nodes above it, but not the cuts elsewhere. Replicas are
compared at the roots, then only children of nodes that differ, down to the records.

A null html is an empty body, a null url an empty address. Pages of one id are ordered by their record's hash, and told apart by their
place among equal ids of a file. A record whose id cannot be read counts as extra, and the one it was as lost. An empty table
gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, drop, offsets, ordered, partitions, scratch_dir, table, tidy

FILE_BYTES = 16 << 20
FAN = 16
#: Files that differ, up to which their names go into the filter of the levels' scans.
FEW = 1000
DATE = "2024-01-01T00:00:00Z"
BEGIN, END = b"WARC/1.0\r\n", b"\r\n\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC resource record as bytes."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record in a file's bytes."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        to = end + 4 + int(head["Content-Length"])
        out.append((head, data[end + 4 : to]))
        at = to + 4
    return out


def hashed(pages: DataFrame) -> DataFrame:
    """page_id, url, record, its length and sha256, `row`, and a key that orders pages of one id."""
    rows = pages.select("page_id", "url", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    length = F.octet_length("record").cast("long")
    return rows.select("page_id", "url", "record", length.alias("length"), F.sha2("record", 256).alias("sha256"), F.monotonically_increasing_id().alias("row")).withColumn("_key", F.col("sha256"))


def laid_out(rows: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """rows with file, seq (place in the file) and offset; files begin where the bytes before pass a multiple of file_bytes."""
    placed = ordered(rows, [F.asc_nulls_last("page_id"), F.col("_key"), F.col("row")], partitions(rows.sparkSession))
    before, _ = offsets(placed, F.sum("length"))
    earlier = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.coalesce(F.sum("length").over(earlier), F.lit(0)))  # a row for each partition
    inside = Window.partitionBy("file")  # some MB of records
    at = at.withColumn("file", F.floor(F.col("_at") / file_bytes))
    return at.withColumn("seq", F.row_number().over(inside.orderBy("_at")) - 1).withColumn("offset", F.col("_at") - F.min("_at").over(inside)).drop("_part", "_pos", "_before", "_at")


def in_files(rows: DataFrame, places: DataFrame) -> DataFrame:
    """rows with the file that places give them, without a join: files are ranges, so the first row of each file tells (one for each FILE_BYTES)."""
    firsts = sorted((r["file"], (r["page_id"] is None, r["page_id"] or 0, r["_key"], r["row"])) for r in places.filter("seq = 0").select("file", "page_id", "_key", "row").collect())
    files, starts = [f for f, _ in firsts], [k for _, k in firsts]

    @F.pandas_udf("long")
    def file_of(page_id: pd.Series, key: pd.Series, row: pd.Series) -> pd.Series:
        keys = zip(page_id.isna(), page_id.fillna(0).astype("int64"), key, row, strict=True)
        return pd.Series([files[bisect_right(starts, k) - 1] for k in keys], dtype="int64")

    return rows.withColumn("file", file_of(F.col("page_id"), "_key", "row"))


def write_warc(rows: DataFrame, path: str, replicas: list[Column], order: list[Column]) -> None:
    """For each replica (a column of what it holds of a record; null: nothing) a gzipped WARC file for each `file`, records in the given order.

    Spark's text writer puts the blank lines behind each record. Records are shuffled once for all replicas.
    """
    held = F.explode(F.array(*[F.struct(F.lit(k).alias("replica"), r.alias("held")) for k, r in enumerate(replicas)]))
    dealt = rows.repartition(partitions(rows.sparkSession), "file").select("*", held.alias("r")).filter("r.held is not null")
    body = F.substring("r.held", F.lit(1), F.octet_length("r.held") - len(END)).cast("string").alias("value")
    sorted_ = dealt.sortWithinPartitions("r.replica", "file", *order).select("r.replica", "file", body)
    sorted_.write.partitionBy("replica", "file").options(**{"lineSep": END.decode(), "zlib.compress.level": "THREE"}).text(path, compression="gzip")


def split(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of each record of a file: by its length if a record or the end follows there, else up to the next beginning."""
    out, at = [], 0
    while at < len(data):
        head = data.find(END, at)
        length = re.search(rb"\r\nContent-Length: (\d+)(?:\r\n|$)", data[at:head]) if head >= 0 and data.startswith(BEGIN, at) else None
        to = head + len(END) + int(length[1]) + len(END) if length else -1
        if not length or to > len(data) or data[to - len(END) : to] != END or (to < len(data) and not data.startswith(BEGIN, to)):
            after = data.find(END + BEGIN, at)
            to = after + len(END) if after >= 0 else len(data)
        out.append((at, to - at))
        at = to
    return out


def index(spark: SparkSession, path: str) -> DataFrame:
    """replica, file, seq, offset, length, id, nth (place among equal ids of the file) and sha256 of each record of the files. Offsets are those of the unpacked file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, packed in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data, seen, rows = zlib.decompress(packed.as_buffer(), wbits=47), {}, []
                replica, file = map(int, re.search(r"replica=(\d+)/file=(\d+)/", name).groups())
                for seq, (at, size) in enumerate(split(data)):
                    one = data[at : at + size]
                    head = re.search(rb"\r\nWARC-Record-ID: <([^>\r\n]*)>\r\n", one.split(END, 1)[0] + b"\r\n")
                    id_ = head[1].decode("utf-8", "replace") if head else f"unreadable:{hashlib.sha256(one).hexdigest()}"
                    rows.append((replica, file, seq, at, size, id_, seen.get(id_, 0), hashlib.sha256(one).hexdigest()))
                    seen[id_] = seen.get(id_, 0) + 1
                for at in range(0, len(rows), 5000):
                    kinds = ["int32", "int64", "int64", "int64", "int64", "string", "int64", "string"]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + 5000]], kind) for k, kind in enumerate(kinds)], names=INDEX)

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(tidy(run), "replica int, file long, seq long, offset long, length long, id string, nth long, sha256 string")


INDEX = ["replica", "file", "seq", "offset", "length", "id", "nth", "sha256"]


def tree(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """Levels from the records to the roots: replica, file, node (a name), up (the node above), first, last (byte range) and hash. leaves: an index of each replica.

    A node is named by the record it ends with; its hash does not depend on where the file has it, its range tells where to read.
    """
    digest = F.xxhash64("id", "nth")
    rows = leaves.select("replica", "file", "seq", F.concat_ws("#", "id", "nth").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"), F.col("sha256").alias("hash"), digest.alias("mark"))
    levels, cutting = [], fan
    while True:
        ends = F.pmod("mark", F.lit(cutting)) == 0
        # The first end from here on; what follows a file's last end hangs under the root's last child.
        back = Window.partitionBy("replica", "file").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a file's records: some MB
        level = cut(rows.withColumn("up", F.coalesce(F.last(F.when(ends, F.col("node")), ignorenulls=True).over(back), F.lit("end"))))
        levels.append(level)
        kids = F.sort_array(F.collect_list(F.struct("seq", "node", "first", "last", "hash", "mark")))
        last = F.element_at("kids", -1)
        up = level.groupBy("replica", "file", "up").agg(kids.alias("kids"))
        mine = F.sha2(F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["node"], k["hash"])), ";"), 256)
        rows = up.select("replica", "file", last["seq"].alias("seq"), F.col("up").alias("node"), F.get("kids", F.lit(0))["first"].alias("first"), last["last"].alias("last"), mine.alias("hash"), F.when(F.col("up") == "end", F.lit(1)).otherwise(last["mark"]).alias("mark"))
        if level.groupBy("replica", "file").count().agg(F.max("count").alias("m")).first()["m"] in (None, 1):
            return levels
        cutting *= fan


def audit(levels: list[DataFrame]) -> DataFrame:
    """file, node and kind (damaged, lost, extra) of the records in which replicas 0 and 1 differ, found from the roots down."""
    wrong: DataFrame | None = None
    for level in reversed(levels):
        if wrong is not None:
            files = [r["file"] for r in wrong.select("file").distinct().limit(FEW + 1).collect()]
            if len(files) <= FEW:  # else the join alone
                level = level.filter(F.col("file").isin(files))
            level = level.join(wrong.select("file", F.col("node").alias("up")).distinct(), ["file", "up"], "left_semi")
        side = lambda k: F.max(F.when(F.col("replica") == k, F.col("hash")))
        sides = level.groupBy("file", "node").agg(side(0).alias("a"), side(1).alias("b"))
        kind = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "lost").otherwise("damaged")
        wrong = cut(sides.filter(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node", kind.alias("kind")))
    return wrong


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a replica in which a known part of the records has a flipped byte: those of urls whose sha256 begins with 00."""
    rows = hashed(table(spark, sf_dir, "pages"))  # scanned twice, which numbers the rows alike; what comes back is counted below
    places = cut(laid_out(rows.select("page_id", "length", "_key", "row")))
    where = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    hit = F.substring(F.sha2(F.coalesce(F.col("url"), F.lit("")), 256), 1, 2) == "00"
    flipped = F.overlay(F.col("record"), F.unhex(F.lit("00")), F.floor(F.octet_length("record") / 2).cast("int"), F.lit(1))
    held = in_files(rows.select("page_id", "_key", "row", "record", hit.alias("hit")), places)
    write_warc(held, where, [F.col("record"), F.when(F.col("hit"), flipped).otherwise(F.col("record"))], [F.asc_nulls_last("page_id"), F.col("_key"), F.col("row")])
    found = cut(index(spark, where))
    discard(spark, where)
    written, planned = (x.groupBy("file").agg(F.count("*").alias("n"), F.sum("length").alias("b")) for x in (found.filter("replica = 0"), places))
    if not written.exceptAll(planned).isEmpty() or not planned.exceptAll(written).isEmpty():
        raise RuntimeError("files do not hold what the layout says: the pages have changed meanwhile")
    levels = tree(found)
    wrong = audit(levels).filter("kind != 'extra'").select("file", "node").withColumn("bad", F.lit(True))
    own = found.filter("replica = 0").select("file", "seq", "offset", "length", "sha256", F.concat_ws("#", "id", "nth").alias("node"))
    pages = places.select("page_id", "file", F.col("seq").cast("long").alias("seq"))
    audited = cut(own.join(wrong, ["file", "node"], "left").join(pages, ["file", "seq"]))
    drop(places, found, *levels)
    return audited.select("page_id", "file", "seq", "offset", "length", "sha256", F.when(F.col("bad"), "damaged").otherwise("intact").alias("fixity"))


ORACLE = f"""
    WITH r AS (
        SELECT page_id, url, encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')
            || '>' || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
            || 'Content-Length: ' || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS raw
        FROM pages
    ), h AS (SELECT page_id, url, CAST(octet_length(raw) AS BIGINT) AS length, sha256(raw) AS sha256 FROM r
    ), p AS (SELECT *, coalesce(sum(length) OVER (ORDER BY page_id NULLS LAST, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM h
    ), f AS (SELECT *, CAST(floor(pos / {FILE_BYTES}) AS BIGINT) AS file FROM p)
    SELECT page_id, file, CAST(row_number() OVER (PARTITION BY file ORDER BY pos) - 1 AS BIGINT) AS seq,
           CAST(pos - min(pos) OVER (PARTITION BY file) AS BIGINT) AS "offset", length, sha256,
           CASE WHEN substr(sha256(coalesce(url, '')), 1, 2) = '00' THEN 'damaged' ELSE 'intact' END AS fixity
    FROM f
"""
