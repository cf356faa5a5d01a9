"""Incremental ingest of versioned documents in two phases.

A version is a table of documents, each with the segment that holds its chunks; a segment is what one ingest has chunked and encoded. A new
version names the segments of the old one that still hold chunks of unchanged documents, so that their files are shared, not copied, and adds
one segment for what is new. Chunks of documents that have changed or gone since are dead: readers leave them out by an
anti-join, and a segment that is mostly dead is written anew without another call to the encoder.

Phases: prepare diffs, writes and counts; commit counts again, makes sure that nobody else has switched, and moves the one pointer that the
chunks and all tables derived from them share. What fails before that leaves the active version as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import write_json
from ..sources.scratch import delete
from ..sources.snapshots import Snapshots

KEY = "source_doc_id"
#: What tells whether a document is unchanged.
COMPARED = ["key", "version_id", "etag", "size", "content_hash"]
#: Dead documents up to which they are broadcast.
FEW = 200_000
#: Changed documents up to which their keys are broadcast to the texts.
CHANGED = 1 << 20
Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Result:
    version: str | None
    previous: str | None
    added: int = 0
    modified: int = 0
    deleted: int = 0
    unchanged: int = 0
    copied_chunks: int = 0
    embedded_chunks: int = 0
    total_chunks: int = 0
    skipped: bool = False


class DocumentIndex:
    """chunk: from (source_doc_id, text) to rows with source_doc_id, chunk_id and more; encode: adds to chunks what a model says of them.

    config: what chunks and vectors depend on; where it changes, all is done anew. derive: tables made from all chunks of a version, by name.
    """

    def __init__(self, store: Snapshots, chunk: Step, encode: Step, config: dict, *, derive: dict[str, Step] | None = None, retain: int = 5, compact_below: float = 0.5):
        self.store, self.chunk, self.encode, self.config = store, chunk, encode, config
        self.derive, self.retain, self.compact_below = derive or {}, retain, compact_below
        self.spark = store.spark

    # ---- reading

    def documents(self, version: str | None = None) -> DataFrame:
        return self.store.table("documents", version)

    def chunks(self, version: str | None = None) -> DataFrame:
        """All live chunks of a version (the active one, resolved once), with their segment."""
        version = version or self.store.active()
        made = self.store.manifest(version) if version else None
        if made is None:
            raise ValueError("no such version")
        return self._live(made, self.store.table("dead", version))

    def _segment(self, name: str) -> str:
        return f"{self.store.root}/segments/{name}"

    def _live(self, made: dict, dead: DataFrame) -> DataFrame:
        rows = self.spark.read.option("mergeSchema", True).parquet(*[self._segment(s) for s in made["segments"]])
        gone = dead.select("segment", KEY)
        return rows.join(F.broadcast(gone) if made["dead"] <= FEW else gone, ["segment", KEY], "left_anti")

    def find(self, collection: str) -> dict | None:
        """The manifest of the version that made a collection."""
        return next((m for m in map(self.store.manifest, self.store.versions()) if m and m["collection"] == collection), None)

    def reconciled(self) -> dict | None:
        """The active version's manifest, marked active; raises where a pointer leads to none."""
        version = self.store.active()
        if version is None:
            return None
        made = self.store.manifest(version)
        if made is None:
            raise RuntimeError(f"{version} has no manifest")
        if made["status"] != "active":
            made = self._say(made, status="active")
        return made

    # ---- writing

    def _say(self, made: dict, **more: object) -> dict:
        made = made | more
        write_json(self.spark, made, f"{self.store.root}/{made['version']}/manifest.json")
        return made

    def differences(self, records: DataFrame, recreate: bool = False) -> DataFrame:
        """records and the active version's documents, with their status and the segment and chunks that the old ones have.

        A changed configuration, or recreate, makes all present documents added ones.
        """
        active = self.store.active()
        kinds = dict(records.dtypes)
        if active is None:
            known = self.spark.createDataFrame([], ", ".join([f"{c} {kinds[c]}" for c in [KEY, *COMPARED]] + ["segment string, n_chunks long"]))
        else:
            known = self.documents(active)
        anew = recreate or (active is not None and self.store.manifest(active)["config"] != self.config)
        before = known.select(KEY, F.col("segment").alias("_segment"), F.col("n_chunks").alias("_n"), *(F.col(c).alias(f"_{c}") for c in COMPARED))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in COMPARED))
        status = F.when(F.col("_now").isNull(), "deleted").when(F.lit(anew) | F.col("_segment").isNull(), "added").when(same, "unchanged").otherwise("modified")
        rows = records.withColumn("_now", F.lit(True)).join(before, KEY, "full_outer").withColumn("status", status)
        return rows.drop("_now", *(f"_{c}" for c in COMPARED))

    def ingest(self, records: DataFrame, texts: Step, *, recreate: bool = False, dry_run: bool = False) -> Result:
        """Makes the active version that of records (source_doc_id, unique, and COMPARED among others). texts: from records to (source_doc_id, text), asked of changed documents only."""
        found = self.prepare(records, texts, recreate=recreate, dry_run=dry_run)
        if dry_run or found.skipped:
            return found
        try:
            self.commit(found)
        except BaseException:
            self.discard(found.version)
            raise
        self.prune(self.retain)
        return found

    def prepare(self, records: DataFrame, texts: Step, *, recreate: bool = False, dry_run: bool = False) -> Result:
        """Builds a candidate next to the active version. Without changes there is none; a dry run counts the differences only."""
        active = self.store.active()
        old = self.store.manifest(active) if active else None
        changes = self.differences(records, recreate)
        # A row for each status and segment; segments are as many as ingests since the last compaction.
        counted = changes.groupBy("status", "_segment").agg(F.count("*").alias("n"), F.sum("_n").alias("chunks")).collect()
        docs = {s: sum(r["n"] for r in counted if r["status"] == s) for s in ("added", "modified", "deleted", "unchanged")}
        if active and not (recreate or docs["added"] or docs["modified"] or docs["deleted"]) and old["config"] == self.config:
            return Result(active, active, **docs, total_chunks=old["total_chunks"], skipped=True)
        version = f"v{(int(active[1:13]) if active else 0) + 1:012d}-{uuid.uuid4().hex[:8]}"
        if dry_run:
            return Result(version, active, **docs)
        live = {r["_segment"]: r["chunks"] or 0 for r in counted if r["status"] == "unchanged"}
        totals = old["segments"] if old else {}
        sparse = sorted(s for s, n in live.items() if n < self.compact_below * totals[s])
        self.store.prepare(version)
        made = {"version": version, "collection": f"chunks__{version}", "previous": active, "config": self.config, "status": "processing", "segments": {}, "dead": 0, "differences": docs}
        try:
            made = self._say(made)
            own = self._write(version, active, changes, texts, sparse, made)
            copied = sum(live.values())
            embedded = own - sum(live[s] for s in sparse)
            kept = {s: totals[s] for s in sorted(live) if s not in sparse} | ({version: own} if own else {})
            made |= {"segments": kept, "dead": self.store.table("dead", version).count()}
            rows = self._live(made, self.store.table("dead", version)) if kept else None
            total = rows.count() if kept else 0
            if total != copied + embedded:
                raise RuntimeError(f"{total} chunks where {copied} copied and {embedded} encoded ones should be")
            for name, step in self.derive.items():
                if kept:
                    step(rows).write.parquet(f"{self.store.root}/{version}/{name}")
            self._say(made, status="candidate", copied_chunks=copied, embedded_chunks=embedded, total_chunks=total)
        except BaseException:
            self.discard(version)
            raise
        return Result(version, active, **docs, copied_chunks=copied, embedded_chunks=embedded, total_chunks=total)

    def _write(self, version: str, active: str | None, changes: DataFrame, texts: Step, sparse: list[str], made: dict) -> int:
        """Writes the new segment, the documents and what is dead; gives the chunks in the segment."""
        root = f"{self.store.root}/{version}"
        new = changes.filter("status in ('added', 'modified')")
        asked = new.drop("status", "_segment", "_n")
        few = made["differences"]["added"] + made["differences"]["modified"] <= CHANGED  # then texts are looked up where they lie; else they are shuffled
        parts = [self.encode(self.chunk(texts(F.broadcast(asked) if few else asked)))]
        if sparse:  # what lives in segments that are mostly dead is taken over with its vectors
            moved = self.chunks(active).filter(F.col("segment").isin(sparse)).join(changes.filter("status = 'unchanged'").select(KEY), KEY, "left_semi")
            parts.append(moved.drop("segment"))
        segment = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("segment", F.lit(version))
        segment.write.parquet(self._segment(version))
        rows = self.spark.read.parquet(self._segment(version))
        counts = rows.groupBy(KEY).agg(F.count("*").alias("_own"))
        now = changes.filter("status <> 'deleted'").join(counts, KEY, "left")
        stays = (F.col("status") == "unchanged") & (~F.col("_segment").isin(sparse) if sparse else F.lit(True))
        placed = now.withColumn("segment", F.when(stays, F.col("_segment")).otherwise(F.lit(version))).withColumn("n_chunks", F.when(stays, F.col("_n")).otherwise(F.coalesce("_own", F.lit(0))).cast("long"))
        placed.drop("status", "_segment", "_n", "_own").write.parquet(f"{root}/documents")
        gone = changes.filter("status in ('deleted', 'modified') or (status = 'added' and _segment is not null)").select(F.col("_segment").alias("segment"), KEY)
        held = self.store.table("documents", version).select("segment").distinct()
        both = gone.unionByName(self.store.table("dead", active).select("segment", KEY)) if active else gone
        both.join(F.broadcast(held), "segment", "left_semi").distinct().write.parquet(f"{root}/dead")  # as many segments as ingests since the last compaction
        return rows.count()

    def commit(self, prepared: Result) -> bool:
        """Moves the pointer to a prepared version. False where it is active already; raises where it is not whole, has other chunks than it was prepared with, or another version than its predecessor is active."""
        made = self.store.manifest(prepared.version)
        if made is None or made["status"] not in ("candidate", "active"):
            raise RuntimeError(f"{prepared.version} is not ready")
        active = self.store.active()
        if active == prepared.version:
            self.reconciled()
            return False
        if active != prepared.previous:
            raise RuntimeError(f"{active} is active, not {prepared.previous}")
        n = self.chunks(prepared.version).count() if made["segments"] else 0
        if n != prepared.total_chunks:
            raise RuntimeError(f"{n} chunks, not {prepared.total_chunks}")
        self.store.activate(prepared.version, active)
        self._say(made, status="active")
        return True

    def discard(self, version: str) -> None:
        """Deletes a candidate and its segment; the active version stays."""
        if self.store.active() != version and self.store.candidate() == version:
            self.store.discard(version)
            delete(self.spark, self._segment(version))

    def prune(self, keep: int) -> list[str]:
        """Deletes old versions, and segments that no version names any more."""
        gone = self.store.prune(keep)
        named = {s for v in self.store.versions() for s in (self.store.manifest(v) or {}).get("segments", {})} | {self.store.candidate()}
        for s in self.segments():
            if s not in named:
                delete(self.spark, self._segment(s))
        return gone

    def segments(self) -> list[str]:
        return self.store._names(f"{self.store.root}/segments")
