"""The session store as a stream of commands with state by session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.text import clean_title
from ..operators.lifecycle import SESSION_TTL

COMMAND = "session_id long, place long, event_id string, kind string, user_id long, question string, answer string, title string, summary string, compacted long"
OUT = "session_id long, event_id string, kind string, seq long, role string, content string, title string, summary string, compacted long"
SESSION = "user_id long, last_seq long, title string, summary string, compacted long, deleted boolean"
STORED = "session_id long, user_id long, last_seq long, title string, summary string, compacted long"
#: The title of a session that has none yet, and the kinds that ask for the session's owner.
UNTITLED, OWNED = "New chat", ("rename", "delete")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Sessions(StatefulProcessor):
    """What a session is stays; its messages and the ids of its events live as long as their last use is not `ttl` seconds ago."""

    def __init__(self, ttl: float, hot: int):
        self.ttl, self.most = int(ttl * 1000), hot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", SESSION)
        self.messages = handle.getListState("messages", "seq long, role string, content string, event_id string", ttlDurationMs=self.ttl)
        self.seen = handle.getMapState("seen", "event_id string", "kind string", ttlDurationMs=self.ttl)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N802, N803
        r = initialState
        self.session.update((r.user_id, r.last_seq or 0, r.title or UNTITLED, r.summary or "", r.compacted or 0, False))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        owner, seq, title, summary, compacted, deleted = self.session.get() or (None, 0, UNTITLED, "", 0, False)
        held = [tuple(m) for m in self.messages.get()]

        def told(r: Row, kind: str, seq: int | None = None, role: str | None = None, content: str | None = None, event: str | None = None) -> Row:
            return Row(session_id=key[0], event_id=event or r.event_id, kind=kind, seq=seq, role=role, content=content, title=title, summary=summary, compacted=compacted)

        later = lambda r: (r.place is None, r.place or 0, r.event_id or "")
        for r in sorted(rows, key=later):  # one session's part of a micro-batch
            if r.event_id is not None:
                if self.seen.containsKey((r.event_id,)):
                    continue
                self.seen.updateValue((r.event_id,), (r.kind,))
            if deleted or (r.kind in OWNED and owner is not None and r.user_id != owner) or r.kind not in ("append", "rename", "delete", "clear", "list"):
                yield told(r, "refused")
            elif r.kind == "append":
                owner = r.user_id if owner is None else owner
                title = r.title if title == UNTITLED and r.title else title
                summary = r.summary if r.summary is not None else summary
                compacted += max(0, r.compacted or 0)
                for role, content in (("user", r.question), ("assistant", r.answer)):
                    seq += 1
                    event = f"{r.event_id}:{role}" if r.event_id is not None else None
                    held.append((seq, role, content, event))
                    yield told(r, "message", seq, role, content, event)
            elif r.kind == "rename":
                title = r.title or title
                yield told(r, "rename")
            elif r.kind == "list":
                if not held:
                    yield told(r, "miss")  # the archive has them
                for n, role, content, event in held:
                    yield told(r, "listed", n, role, content, event)
            else:
                deleted, held = r.kind == "delete", []
                yield told(r, r.kind)
        self.session.update((owner, seq, title, summary, compacted, deleted))
        if held:
            self.messages.put(held[-self.most :])  # writing them anew is what makes their lifetime slide
        else:
            self.messages.clear()


def session_stream(commands: DataFrame, stored: DataFrame | None = None, *, ttl: float = SESSION_TTL, hot: int = 400, title_limit: int = 40) -> DataFrame:
    """What each command (COMMAND) does to its session, in order of place, then event id, within a micro-batch; rows as in OUT.

    Kinds: append (two rows of kind message, numbered on), rename and delete (by the session's owner, who is the user of its first append or
    of `stored`), clear (forgets the messages that are hot), list (hot messages as rows of kind listed, or one miss where there are none). What is
    not allowed, or comes after a delete, gives one row of kind refused. A command whose event id was seen gives nothing, so that a batch or event
    that is delivered again changes nothing; ids are forgotten after ttl seconds, as are hot messages that no command has touched for so long.
    Numbers never repeat. Rows without a session take no part. stored: one row (STORED) for each session from before the stream. No more than
    the newest `hot` messages are held. The RocksDB state store is set here, and batches without data are switched off, as lifetimes would
    otherwise call for them without end and a query over what is available would not stop.
    """
    for name, value in (("stateStore.providerClass", PROVIDER), ("noDataMicroBatches.enabled", "false")):
        commands.sparkSession.conf.set(f"spark.sql.streaming.{name}", value)
    names = [c.split()[0] for c in COMMAND.split(", ")]
    clean = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", clean_title(F.col("title"), title_limit))
    rows = commands.filter("session_id is not null").withColumn("title", clean).select(*names)
    before = None if stored is None else stored.filter("session_id is not null").select(*(c.split()[0] for c in STORED.split(", "))).groupBy("session_id")
    return rows.groupBy("session_id").transformWithState(_Sessions(ttl, hot), StructType.fromDDL(OUT), "append", "processingTime", initialState=before)
