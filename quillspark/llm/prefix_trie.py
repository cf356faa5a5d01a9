"""The trie of conversation prefixes.

Every turn gets a 64-bit hash, and the prefix up to it the polynomial sum of the hashes so far, modulo 2^64, by numpy scans
over turns in order; a conversation that spans tasks is put together from its parts' sums. Turns of one depth and one fingerprint are a
candidate node. A candidate is verified turn by turn: its least and its greatest content (fingerprint before the turn, role, text) must both be
its representative's. Where they differ, the turns unlike the representative's get another hash, prefixes are summed again, and so on until
no candidate mixes contents. Then, from the root down, equal fingerprints mean equal prefixes.

A node belongs to its smallest member. What a node adds to the nodes above it (its tokens saved, its being a leaf) is credited to that
conversation; a node's own sums are those of its members, less what its owner owns above it. So values reach all ancestors by
two aggregations, whatever the depth, and no level waits for another.

Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out. Rows of one place are ordered by role,
then text; repeated rows are repeated turns. Extra columns play no part, whatever their names. Without conversations there is no row.
No group, not even the root's or that of a conversation with a third of all rows, meets in one task: sums are combined before they
are shuffled, conversations are split by depth, and parents with many children, fewer than 100,000 at any size, are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, drop, partitions, table, tidy

#: The base of the polynomial, an odd number.
BASE = 0x9E3779B97F4A7C15
WRAP = 1 << 64
#: Turns of one conversation that meet its totals in one task.
SLICE = 4096


def scanned(rows: DataFrame, key: str, order: list[Column], value: str, base: int = 1) -> DataFrame:
    """rows in order of key and order, with `_n` (number within the key, from 1), `_sum` (of value * base^_n up to the row, modulo 2^64) and `_before` (up to the row before).

    A key may span tasks: each task sums its own part of it, and the driver, which gets one row for each task, tells the task that goes
    on with a key what the ones before have. `_n`, `_sum` and `_before` are added to the columns; key and value are longs without nulls.
    """
    base &= WRAP - 1
    names = [f.name for f in rows.schema]
    keys = [F.col(key), *order, F.col("_tie")]  # many equal rows are parted as well
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *keys)
    dealt = dealt.sortWithinPartitions(key, *order).drop("_tie").withColumn("_part", F.spark_partition_id())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, total = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(names.index(key)).to_numpy()
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(own)]))
            place = np.arange(len(own)) - starts[group] + 1
            weights = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(place.max()), base, "uint64")])
            terms = b.column(names.index(value)).to_numpy().astype("int64").view("uint64") * weights[place]
            sums = np.cumsum(terms, dtype="uint64")
            sums -= np.r_[np.uint64(0), sums[starts[1:] - 1]][group]
            before = sums - terms
            if own[0] == last:
                first, shift = group == 0, np.uint64(pow(base, n, WRAP))
                place[first] += n
                for x in (sums, before):
                    x[first] = x[first] * shift + np.uint64(total)
            last, n, total = own[-1], int(place[-1]), int(sums[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x.view("int64")) for x in (place, sums, before))], names=[*b.schema.names, "_n", "_sum", "_before"])

    whole = StructType([*dealt.schema.fields, *(StructField(c, LongType()) for c in ("_n", "_sum", "_before"))])
    kept = cut(dealt.mapInArrow(tidy(local), whole))
    carried: dict[int, tuple[int, int, int]] = {}
    open_key, n, total = None, 0, 0
    ends = kept.groupBy("_part").agg(F.min(key).alias("first"), F.max(F.struct(key, "_n", "_sum")).alias("last")).orderBy("_part")
    for part, first, (last, size, tail) in ends.collect():  # a row for each task
        if first == open_key:
            carried[part] = first, n, total
        if last == open_key:
            n, total = n + size, (total + pow(base, n, WRAP) * tail) % WRAP
        else:
            open_key, n, total = last, size, tail % WRAP

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, at = list(b.columns), b.schema.get_field_index("_part")
            place, sums, before = (x.to_numpy().copy() for x in columns[-3:])
            own, parts = columns[names.index(key)].to_numpy(), columns[at].to_numpy()
            for part in np.unique(parts).tolist():
                if part in carried:
                    first, n, total = carried[part]
                    some = (parts == part) & (own == first)
                    place[some] += n
                    for x in (sums, before):
                        x.view("uint64")[some] = x.view("uint64")[some] * np.uint64(pow(base, n, WRAP)) + np.uint64(total)
            yield pa.RecordBatch.from_arrays([*columns[:at], *(pa.array(x) for x in (place, sums, before))], names=[*b.schema.names[:at], "_n", "_sum", "_before"])

    out = kept.mapInArrow(tidy(joined), StructType([f for f in whole if f.name != "_part"])) if carried else kept.drop("_part")
    out._scratch = kept._scratch
    return out


@dataclass
class Trie:
    """nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, fingerprint. ends: conv_id, depth and fingerprint of the node at which each conversation ends. scratch: the tables that these read."""

    nodes: DataFrame
    ends: DataFrame
    scratch: list[DataFrame]


def candidates(turns: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(turns by depth with fingerprints, verified candidates), both scratch tables. bits: of the fingerprint, fewer only in tests."""
    mask = (1 << bits) - 1 if bits < 64 else -1
    rows, redone = turns.withColumn("salt", F.lit(0)), 0
    while True:
        value = F.xxhash64("role", "text", "salt")
        placed = scanned(rows.withColumn("_h", value), "conv_id", [F.col("place"), F.col("role"), F.col("text")], "_h", BASE)
        fp, parent = (F.col(c).bitwiseAND(F.lit(mask)) for c in ("_sum", "_before"))
        deep = placed.select("conv_id", F.col("_n").alias("depth"), fp.alias("fp"), parent.alias("parent"), "role", "text", "salt")
        content = F.struct("parent", "role", "text")
        found = deep.groupBy("depth", "fp").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(content).alias("low"), F.max(content).alias("high"))
        nodes = cut(found.select("depth", "fp", "conv_id", "n_convs", F.col("low.parent").alias("parent"), F.length("low.text").cast("long").alias("chars"), (F.col("low") != F.col("high")).alias("mixed")))
        if nodes.filter("mixed").isEmpty():
            members = cut(deep.select("conv_id", "depth", "fp"))
            drop(placed)
            return members, nodes
        mixed = nodes.filter("mixed").select("depth", "fp", F.col("conv_id").alias("least"))
        among = deep.join(mixed, ["depth", "fp"])
        model = among.filter("conv_id = least").select("depth", "fp", content.alias("model"))
        unlike = among.join(model, ["depth", "fp"]).filter(content != F.col("model")).select("conv_id", "depth", F.lit(1).alias("_unlike"))
        again = deep.join(unlike, ["conv_id", "depth"], "left")
        redone += 1
        kept = cut(again.select("conv_id", F.col("depth").alias("place"), "role", "text", F.when(F.col("_unlike") == 1, redone).otherwise(F.col("salt")).alias("salt")))
        drop(placed, nodes)
        rows = kept


def trie(turns: DataFrame, conversations: DataFrame | None = None, bits: int = 64) -> Trie:
    """The trie of all prefixes. turns: conv_id (long), place (any that sorts), role, text; conversations: conv_id, also of those without turns (as in turns where not given)."""
    spark = turns.sparkSession
    clean = turns.filter("conv_id is not null").select("conv_id", "place", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    convs = (conversations if conversations is not None else clean).select("conv_id").filter("conv_id is not null").distinct()
    deep, found = candidates(clean, bits)
    zero = F.lit(0).cast("long")
    members = deep.unionByName(convs.select("conv_id", zero.alias("depth"), zero.alias("fp")))
    ends = cut(members.groupBy("conv_id").agg(F.max(F.struct("depth", "fp")).alias("e")).select("conv_id", "e.depth", "e.fp"))
    top = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = top.select(zero.alias("depth"), zero.alias("fp"), "conv_id", "n_convs", F.lit(None).cast("long").alias("parent"), zero.alias("chars"))
    nodes = found.drop("mixed").unionByName(root)

    # Children, from below; then what each node adds to those above, credited to its owner.
    borne = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("fp")).agg(F.count("*").alias("n_children"))
    own = [c for c in nodes.columns if c not in ("depth", "fp")]
    both = nodes.withColumn("n_children", zero).unionByName(borne, allowMissingColumns=True)
    one = cut(both.groupBy("depth", "fp").agg(*(F.max(c).alias(c) for c in own), F.sum("n_children").alias("n_children")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")))
    owned = one.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    slice_ = lambda c: F.floor(c / SLICE)
    credit = owned.join(ends, "conv_id").select("conv_id", "saved", "leaves", F.explode(F.sequence(F.lit(0).cast("long"), slice_(F.col("depth")))).alias("slice"))
    sums = members.withColumn("slice", slice_(F.col("depth"))).join(credit, ["conv_id", "slice"]).groupBy("depth", "fp").agg(F.sum("saved").alias("saved_below"), F.sum("leaves").alias("n_leaves"))
    before = scanned(one.select("depth", "fp", "conv_id", "saved"), "conv_id", [F.col("depth")], "saved")
    values = [c for c in one.columns if c not in ("depth", "fp", "saved")]
    every = one.drop("saved").unionByName(sums, allowMissingColumns=True).unionByName(before.select("depth", "fp", F.col("_before").alias("above")), allowMissingColumns=True)
    two = cut(every.groupBy("depth", "fp").agg(*(F.max(c).alias(c) for c in [*values, "saved_below", "n_leaves", "above"])))
    drop(deep, found, one, before)
    out = two.select("conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", (F.col("saved_below") - F.col("above")).alias("saved_tokens"), "fp")
    return Trie(_with_parents(spark, out).withColumnRenamed("fp", "fingerprint"), ends.withColumnRenamed("fp", "fingerprint"), [two, ends])


def _with_parents(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id. Parents of more than a 100,000th of all nodes are fewer than 100,000 and are broadcast; the others are joined."""
    limit = max(4096, nodes.count() // 100_000)
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = F.broadcast(parents.filter(F.col("n_children") > limit).drop("n_children"))
    few = parents.filter(F.col("n_children") <= limit).drop("n_children")
    tried = nodes.join(many, ["depth", "parent"], "left")
    done = tried.filter("parent_conv_id is not null or depth = 0")
    rest = nodes.filter("depth > 0").join(many, ["depth", "parent"], "left_anti").join(few, ["depth", "parent"])
    return done.unionByName(rest).drop("parent")


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, fingerprint and ends_sha256: the checksum of the comma-joined ids, ascending, of the conversations that end at a node.

    Each task joins the ids it has of a node; these pieces then meet in order and are hashed one after the other, none being kept.
    """
    node = ["depth", "fingerprint"]
    dealt = ends.select(*node, "conv_id").repartitionByRange(partitions(ends.sparkSession), *node, "conv_id").sortWithinPartitions(*node, "conv_id").withColumn("part", F.spark_partition_id())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for b in batches:
            if not b.num_rows:
                continue
            depth, fp, ids, part = (b.column(c).to_numpy() for c in (*node, "conv_id", "part"))
            edges = np.flatnonzero(np.r_[True, (depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1]), True])
            some, n = edges[:-1], len(edges) - 1
            text = [",".join(map(str, ids[x:y].tolist())) for x, y in zip(some, edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(depth[some]), pa.array(fp[some]), pa.array(part[some]), pa.array(np.arange(seq, seq + n)), pa.array(text, "string")], names=[*node, "part", "seq", "ids"])
            seq += n

    pieces = dealt.mapInArrow(tidy(join), "depth long, fingerprint long, part int, seq long, ids string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, []
        for b in batches:
            for d, f, ids in zip(b.column("depth").to_pylist(), b.column("fingerprint").to_pylist(), b.column("ids"), strict=True):
                if (d, f) == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (d, f), hashlib.sha256()
                sha.update(ids.as_buffer())
            yield told(done)
            done.clear()
        if now is not None:
            yield told([(*now, sha.hexdigest())])

    def told(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], "int64"), pa.array(columns[1], "int64"), pa.array(columns[2], "string")], names=[*node, "ends_sha256"])

    return pieces.repartition(partitions(ends.sparkSession), *node).sortWithinPartitions(*node, "part", "seq").mapInArrow(tidy(digest), "depth long, fingerprint long, ends_sha256 string")


def rebuilt(conversations: DataFrame, shared: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(turns, conversations, scratch tables that these read) of the query: each conversation begins with up to shared - 1 first turns of the first of its family, the rest are its own later ones."""
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")), F.lit(0).cast("long").alias("_zero"))
    scan = scanned(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "_zero")
    placed = scan.select("conv_id", F.col("_n").alias("place"), "role", "text")
    heads = lambda c: F.crc32(c.cast("string")) % shared
    convs = cut(placed.select("conv_id").distinct())
    first = placed.filter((F.col("conv_id") % family == 0) & (F.col("place") < shared)).withColumnRenamed("conv_id", "_first")
    asked = convs.withColumn("_first", F.col("conv_id") - F.col("conv_id") % family)
    begun = asked.join(first, "_first").filter(F.col("place") <= heads(F.col("conv_id"))).drop("_first")  # at most family conversations meet shared - 1 turns
    return placed.filter(F.col("place") > heads(F.col("conv_id"))).unionByName(begun), convs, [scan, convs]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs, scratch = rebuilt(table(spark, sf_dir, "conversations"))
    found = trie(turns, convs)
    digest = ends_digests(found.ends)
    none = F.sha2(F.lit(""), 256)
    rows = found.nodes.join(digest, ["depth", "fingerprint"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    out = cut(rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    drop(*scratch, *found.scratch)
    return out
