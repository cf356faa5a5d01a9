"""Conversation sessions: sequences, histories, archives and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, token_estimate, trim_text


def backfilled(messages: DataFrame, session: str, order: str, seq: str) -> DataFrame:
    """Rows without a sequence number get the next ones of their session, in order."""
    known = messages.filter(F.col(seq).isNotNull()).groupBy(session).agg(F.max(seq).alias("_max"))
    place = F.row_number().over(Window.partitionBy(session).orderBy(order))
    open_ = messages.filter(F.col(seq).isNull()).join(known, session, "left").withColumn(seq, (place + F.coalesce("_max", F.lit(0))).cast("long")).drop("_max")
    return messages.filter(F.col(seq).isNotNull()).unionByName(open_)


def clean_history(messages: DataFrame) -> DataFrame:
    """Messages of users and assistants that are not blank. messages: conv_id, turn, role, text."""
    return messages.withColumn("content", strip(F.col("text"))).filter((F.col("content") != "") & F.col("role").isin("user", "assistant"))


def recent(messages: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def search_queries(messages: DataFrame, questions: DataFrame, n: int = 2, limit: int = 3000) -> DataFrame:
    """(conv_id, search_query): the last n messages of the user and the question, a line each, of which the end stays within the limit.

    messages: as clean_history gives them; questions: conv_id, question, one each; a conversation without messages has its question alone.
    """
    two = recent(messages.filter("role = 'user'"), n).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "content"))).alias("m"))
    lines = F.coalesce(F.transform("m", lambda x: x["content"]), F.array().cast("array<string>"))
    every = F.array_join(F.concat(lines, F.array(strip(F.coalesce("question", F.lit(""))))), "\n")
    return questions.join(two, "conv_id", "left").select("conv_id", trim_text(every, limit, "tail").alias("search_query"))


def formatted(messages: DataFrame) -> DataFrame:
    """(conv_id, history): 'ROLE: content' in order, parted by blank lines."""
    line = F.concat(F.upper("role"), F.lit(": "), F.col("content"))
    rows = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("m"))
    return rows.select("conv_id", F.array_join(F.transform("m", lambda x: x["line"]), "\n\n").alias("history"))


def last_exchange(messages: DataFrame) -> DataFrame:
    """(conv_id, assistant_turn, assistant_text, user_text): the last assistant message and the last user message before it."""
    a = messages.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("assistant_turn"), F.max_by("content", "turn").alias("assistant_text"))
    u = messages.filter("role = 'user'").join(a.select("conv_id", "assistant_turn"), "conv_id").filter(F.col("turn") < F.col("assistant_turn"))
    u = u.groupBy("conv_id").agg(F.max_by("content", "turn").alias("user_text"))
    return a.join(u, "conv_id", "left").withColumn("user_text", F.coalesce("user_text", F.lit("")))


def compaction(messages: DataFrame, recent_turns: int, available: int) -> DataFrame:
    """(conv_id, history_tokens, compact, n_compacted): whether a history exceeds the budget, and how many old messages then fold."""
    rows = formatted(messages).join(messages.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id")
    tokens = token_estimate(F.col("history"))
    older = F.greatest(F.col("n") - 2 * recent_turns, F.lit(0))
    compact = (tokens > available) & (older > 0) & F.lit(recent_turns > 0)
    return rows.select("conv_id", tokens.alias("history_tokens"), compact.alias("compact"), F.when(compact, older).otherwise(0).cast("long").alias("n_compacted"))


def archive(existing: DataFrame, batch: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New archive rows, and sessions with their archived sequence. Replays change nothing.

    Rows (event_id, session_id, seq, ...) without ids or of unknown sessions are dropped; a row is known by its event id or by
    its session and sequence, in the archive or earlier in the batch. A session's archived sequence follows all rows of the batch that
    the archive has afterwards, so that a full replay lifts one that lags.
    """
    good = batch.filter(F.coalesce(F.trim("event_id"), F.lit("")) != "").filter(F.col("session_id").isNotNull()).join(sessions.select("session_id"), "session_id", "left_semi")
    one = lambda df, keys: df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "event_id"))).filter("_r = 1").drop("_r")
    fresh = one(one(good, ["event_id"]), ["session_id", "seq"])
    fresh = fresh.join(existing.select("event_id"), "event_id", "left_anti").join(existing.select("session_id", "seq"), ["session_id", "seq"], "left_anti")
    fresh = fresh.select(*batch.columns)
    last = good.groupBy("session_id").agg(F.max("seq").alias("_last"))
    moved = sessions.join(last, "session_id", "left").withColumn("archive_seq", F.greatest("archive_seq", F.coalesce("_last", "archive_seq"))).drop("_last")
    return existing.unionByName(fresh), moved


def overlaid(archived: DataFrame, pending: DataFrame) -> DataFrame:
    """The archive and those pending rows that it has neither by event nor by session and sequence."""
    more = pending.join(archived.select("event_id"), "event_id", "left_anti").join(archived.select("session_id", "seq"), ["session_id", "seq"], "left_anti")
    return archived.unionByName(more.select(*archived.columns))


def role_runs(messages: DataFrame) -> DataFrame:
    """(conv_id, run, role, content): neighbouring messages of one role merged; system messages lifted out."""
    rows = messages.filter("role <> 'system'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    change = F.when(F.lag("role").over(w) == F.col("role"), 0).otherwise(1)
    rows = rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("conv_id", "run", "role").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("m"))
    return merged.select("conv_id", "run", "role", F.array_join(F.transform("m", lambda x: x["text"]), "\n\n").alias("content"))


def hysteresis(probes: DataFrame, by: str, order: list[str], failures: int = 2, recoveries: int = 2) -> DataFrame:
    """probes with `degraded`: on after so many failures in a row, off after so many successes in a row. probes has ok."""
    w = Window.partitionBy(by).orderBy(*order)
    back = lambda n, want: _all([F.coalesce((F.lag("ok", i).over(w) if i else F.col("ok")) == F.lit(want), F.lit(False)) for i in range(n)])
    signal = F.when(back(failures, False), True).when(back(recoveries, True), False)
    rows = probes.withColumn("_s", signal)
    return rows.withColumn("degraded", F.coalesce(F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))).drop("_s")


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def appended(exchanges: DataFrame, last: DataFrame, floor: int = 0) -> DataFrame:
    """Two messages for each exchange with the next sequence numbers of its session.

    exchanges: session_id, place, event_id, question, answer; last: session_id, last_seq. floor: least first number of a new run.
    """
    start = F.greatest(F.coalesce("last_seq", F.lit(0)), F.lit(floor - 1).cast("long"))
    k = F.row_number().over(Window.partitionBy("session_id").orderBy("place"))
    rows = exchanges.join(last, "session_id", "left").withColumn("_s", start + 2 * (k - 1))
    one = lambda n, role, c: F.struct((F.col("_s") + n).cast("long").alias("seq"), F.lit(role).alias("role"), F.col(c).alias("content"))
    pair = F.explode(F.array(one(1, "user", "question"), one(2, "assistant", "answer")))
    return rows.select("session_id", "event_id", pair.alias("m")).select("session_id", "event_id", "m.*")


def titled(sessions: DataFrame, first: DataFrame, title: Column) -> DataFrame:
    """Sessions whose title is still the default take that of their first question. first: session_id and what title reads."""
    rows = sessions.join(first, "session_id", "left").withColumn("_t", title)
    return rows.withColumn("title", F.when((F.col("title") == "New chat") & F.col("_t").isNotNull(), F.col("_t")).otherwise(F.col("title"))).select(*sessions.columns)
