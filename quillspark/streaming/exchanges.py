"""Exchanges of sessions as a stream: consecutive messages and what a session carries along, kept as state by session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import clean_title

MESSAGE = "session_id long, event_id string, seq long, role string, content string, title string, summary string, compacted long"
STATE = "last_seq long, title string, summary string, compacted long"
#: The title of a session that has none yet.
UNTITLED = "New chat"


def append_stream(exchanges: DataFrame, last: DataFrame, title_limit: int = 40) -> DataFrame:
    """Two messages for each exchange, numbered on from the session's last one, with the session as it stands afterwards.

    exchanges: session_id, place, event_id, question, answer, title, summary, compacted; last: session_id, last_seq, title, summary,
    compacted of sessions that were stored before the stream began, one row each. Within a micro-batch exchanges go by place and event id. A title
    is taken only while the session has none; a null summary leaves the old one; only positive counts add to `compacted`. Rows
    without a session take no part, and an exchange whose event id is null gets messages without ids. A session's numbers live as long as
    the checkpoint: one row of state each. Which messages are hot is for `lifecycle.alive` to say.
    """
    stored = last.select("session_id", *(F.col(c).alias(f"old_{c}") for c in ("last_seq", "title", "summary", "compacted")))
    own = clean_title(F.nullif("title", F.lit("")), title_limit)
    rows = exchanges.filter(F.col("session_id").isNotNull()).withColumn("title", own).join(stored, "session_id", "left")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(frames)).sort_values(["place", "event_id"], kind="stable", na_position="last")  # one session's part of a micro-batch
        at = lambda name, default: batch[f"old_{name}"].iloc[0] if pd.notna(batch[f"old_{name}"].iloc[0]) else default
        if state.exists:
            seq, title, summary, compacted = state.get
        else:
            seq, title, summary, compacted = int(at("last_seq", 0)), at("title", UNTITLED), at("summary", ""), int(at("compacted", 0))
        out = []
        for r in batch.itertuples(index=False):
            title = r.title if title == UNTITLED else title
            summary = r.summary if isinstance(r.summary, str) else summary
            compacted += max(0, int(r.compacted)) if pd.notna(r.compacted) else 0
            for role, content in (("user", r.question), ("assistant", r.answer)):
                seq += 1
                event = f"{r.event_id}:{role}" if isinstance(r.event_id, str) else None
                out.append((key[0], event, seq, role, content, title, summary, compacted))
        state.update((seq, title, summary, compacted))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MESSAGE.split(", ")])

    return rows.groupBy("session_id").applyInPandasWithState(step, MESSAGE, STATE, "append", GroupStateTimeout.NoTimeout)
