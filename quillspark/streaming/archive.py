"""Streams: exchanges into an archive, once each; health over probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sessions import archive
from .commits import CommittedTables

EVENT = "event_id string, session_id long, seq long, role string, content string"
#: Folders of the archive; fixed once it has rows.
BUCKETS = 256
#: Files that one batch may add to a folder, so that a hot session is not one task.
SPLIT = 4


def split_malformed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, raw rows that are no events) of a column `value`."""
    rows = events.withColumn("e", F.from_json("value", EVENT))
    good = F.col("e").isNotNull() & (F.coalesce(F.trim("e.event_id"), F.lit("")) != "") & F.col("e.session_id").isNotNull() & F.col("e.seq").isNotNull()
    return rows.filter(good).select("e.*"), rows.filter(~F.coalesce(good, F.lit(False))).select("value")


def bucket(session: Column) -> Column:
    """The folder of the archive that holds a session."""
    return F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")


def archive_stream(events: DataFrame, sessions: DataFrame, out: str, dead: str, checkpoint: str) -> StreamingQuery:
    """Writes each event once. A batch that is replayed after a failure finds its rows in the archive and adds none.

    Every batch is one append after an anti-join with what its sessions have, so that commit and acknowledgement cannot part. The
    archive is parted by a hash of the session, and a batch reads only the folders of its own sessions; an event id belongs to one session.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        batch.persist()
        good, bad = split_malformed(batch)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            own = [r["b"] for r in good.select(bucket(F.col("session_id")).alias("b")).distinct().collect()]  # BUCKETS at most
            known = spark.read.schema(f"{EVENT}, bucket int").parquet(out).filter(F.col("bucket").isin(own)).drop("bucket")
        else:
            known = spark.createDataFrame([], EVENT)
        full, _ = archive(known.limit(0), good, sessions.withColumn("archive_seq", F.lit(0).cast("long")))
        fresh = full.join(known.select("event_id"), "event_id", "left_anti").join(known.select("session_id", "seq"), ["session_id", "seq"], "left_anti")
        rows = fresh.select(*known.columns, bucket(F.col("session_id")).alias("bucket"))
        rows.repartition("bucket", F.pmod(F.xxhash64("event_id"), F.lit(SPLIT))).write.partitionBy("bucket").mode("append").parquet(out)
        bad.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{dead}/batch={number}")
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SESSION = "session_id long, archive_seq long"


def archived_sessions(tables: CommittedTables, stored: DataFrame) -> DataFrame:
    """(session_id, archive_seq) as the last commit that touched a session left it; stored: what there was before."""
    every = stored.select("session_id", "archive_seq", F.lit(0).cast("long").alias("_commit")).unionByName(tables.read("sessions", SESSION))
    return every.groupBy("session_id").agg(F.max_by("archive_seq", F.struct("_commit", "archive_seq")).alias("archive_seq"))


def commit_batch(tables: CommittedTables, query: str, number: int, events: DataFrame, stored: DataFrame) -> bool:
    """One batch of raw events (a column `value`): new rows of the archive, sessions with their archived sequence, and what is no event, all in one commit."""
    if tables.committed(query, number):
        return False
    good, bad = split_malformed(events)
    own = [r["b"] for r in good.select(bucket(F.col("session_id")).alias("b")).distinct().collect()]  # BUCKETS at most
    known = tables.read("archive", f"{EVENT}, bucket int").filter(F.col("bucket").isin(own)).drop("bucket", "_commit")
    before = archived_sessions(tables, stored).join(good.select("session_id").distinct(), "session_id", "left_semi")
    _, moved = archive(known, good, before)
    full, _ = archive(known.limit(0), good, before)
    fresh = full.join(known.select("event_id"), "event_id", "left_anti").join(known.select("session_id", "seq"), ["session_id", "seq"], "left_anti")
    rows = fresh.select(*known.columns, bucket(F.col("session_id")).alias("bucket")).repartition("bucket", F.pmod(F.xxhash64("event_id"), F.lit(SPLIT)))
    return tables.commit(query, number, {"archive": rows, "sessions": moved.select("session_id", "archive_seq"), "dead": bad}, by={"archive": "bucket"})


def session_archive_stream(events: DataFrame, stored: DataFrame, root: str, checkpoint: str, name: str) -> StreamingQuery:
    """Archive and sessions, committed together under root, once for each batch of the query called name. stored: session_id, archive_seq of known sessions.

    A batch that fails between its tables is seen in none of them, and is written anew when the query starts again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        commit_batch(CommittedTables(batch.sparkSession, root), name, number, batch, stored)
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: events by type in tumbling windows of event time; works on streams and tables alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
