"""Sessions, accounts and stores over their lifetime: owner-scoped changes, sign-ins, settings, hot overlays, caches, recoveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import URL_NAMESPACE, clean_title, name_uuid, strip
from ..sources.scratch import drop, stored

#: Events that may wait before writes are refused, seconds that a session and a cached sign-in live.
BACKLOG, SESSION_TTL, SIGN_IN_TTL = 100_000, 7 * 86_400, 60


# ---- sessions


def created(sessions: DataFrame, wanted: DataFrame, at: Column, title: str = "New chat") -> DataFrame:
    """sessions (session_id, user_id, title, created_at, updated_at) with new ones of the wanted ids (session_id, user_id); an id that is there, or has no user, makes none."""
    fresh = wanted.filter("session_id is not null and user_id is not null").groupBy("session_id").agg(F.min("user_id").alias("user_id"))
    rows = fresh.join(sessions.select("session_id"), "session_id", "left_anti").withColumns({"title": F.lit(title), "created_at": at, "updated_at": at})
    return sessions.unionByName(rows.select(*sessions.columns))


def owned(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked sessions (session_id, user_id) that are their askers' own; others' are not told from missing ones."""
    return sessions.join(asked.select("session_id", "user_id").distinct(), ["session_id", "user_id"], "left_semi").select(*sessions.columns)


def renamed(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """sessions with the titles that their own users gave them last. changes: session_id, user_id, title, place; others change nothing, of one place the greatest title holds."""
    last = changes.filter("title is not null").groupBy("session_id", "user_id").agg(F.max_by("title", F.struct("place", "title")).alias("_t"))
    rows = sessions.join(last, ["session_id", "user_id"], "left")
    return rows.withColumn("title", F.when(F.col("_t").isNotNull(), clean_title(F.col("_t"))).otherwise(F.col("title"))).select(*sessions.columns)


def owned_delete(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions that their owners delete, and without their messages. gone: session_id, user_id."""
    lost = sessions.join(gone.select("session_id", "user_id"), ["session_id", "user_id"], "left_semi").select("session_id")
    return sessions.join(lost, "session_id", "left_anti").select(*sessions.columns), messages.join(lost, "session_id", "left_anti").select(*messages.columns)


def hot_sessions(stored: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Stored and hot sessions; where both have one, the hot values win, but for those that are null."""
    others = [c for c in stored.columns if c != key]
    s, h = stored.alias("s"), hot.alias("h")
    both = s.join(h, F.col(f"s.{key}") == F.col(f"h.{key}"), "full_outer")
    return both.select(F.coalesce(f"h.{key}", f"s.{key}").alias(key), *[F.coalesce(f"h.{c}", f"s.{c}").alias(c) for c in others])


def pending_state(pending: DataFrame) -> DataFrame:
    """(session_id, last_seq, summary, compacted): the state that the latest pending event of a session carries."""
    return pending.groupBy("session_id").agg(F.max("last_seq").alias("last_seq"), F.max_by("summary", "last_seq").alias("summary"), F.max_by("compacted", "last_seq").alias("compacted"))


def referenced(stream: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stream references with their pending events, and those without one, which are malformed. Both: session_id, event_id."""
    keys = ["session_id", "event_id"]
    return stream.join(pending, keys), stream.join(pending, keys, "left_anti")


def claimed(entries: DataFrame, now: Column, idle: float, consumer: str) -> DataFrame:
    """entries (owner, delivered_at in seconds) with those taken over that another consumer has left idle so long."""
    stale = (F.col("owner") != consumer) & (now - F.col("delivered_at") >= idle)
    return entries.withColumn("claimed", stale).withColumn("owner", F.when(stale, F.lit(consumer)).otherwise(F.col("owner")))


def alive(rows: DataFrame, touched: str, now: Column, ttl: float) -> DataFrame:
    """Rows whose sliding lifetime has not run out. touched: seconds."""
    return rows.filter(now - F.col(touched) < ttl)


def admitted(writes: DataFrame, backlog: Column, most: int = BACKLOG) -> DataFrame:
    """writes with whether they are let in: not while so many events wait."""
    return writes.withColumn("admitted", backlog < most)


def breaker(calls: DataFrame, by: str, order: str) -> DataFrame:
    """calls (kind 'call' or 'ping', ok) with `state`: a failed call opens the circuit; calls then fail fast until a ping succeeds."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    change = F.when((F.col("kind") == "ping") & F.col("ok"), False).when((F.col("kind") == "call") & ~F.col("ok"), True)
    open_ = F.coalesce(F.last(change, ignorenulls=True).over(w), F.lit(False))
    return calls.withColumn("state", F.when((F.col("kind") == "call") & open_, "refused").when(F.col("ok"), "passed").otherwise("failed"))


def replica(seq: Column, available: Column) -> Column:
    """The replica that takes the call of this number, in turn."""
    return F.when(F.size(available) > 0, F.get(available, F.pmod(seq, F.size(available)).cast("int")))


# ---- accounts


def touched(rows: DataFrame, key: str, seen: DataFrame, at: str) -> DataFrame:
    """rows with the last time that each was seen, if later. seen: key and at."""
    last = seen.groupBy(key).agg(F.max(at).alias("_at"))
    return rows.join(last, key, "left").withColumn(at, F.greatest(F.col(at), F.col("_at"))).select(*rows.columns)


def runtime_settings(stored: DataFrame, defaults: DataFrame, secret: str = "api_key") -> DataFrame:
    """(name, value, origin): stored values override defaults; a stored secret that is null keeps the default. Both: name, value."""
    d, s = defaults.select("name", F.col("value").alias("_d")), stored.select("name", F.col("value").alias("_s"), F.lit(True).alias("_there"))
    use = F.col("_there").isNotNull() & ((F.col("name") != secret) | F.col("_s").isNotNull())
    return d.join(s, "name", "full_outer").select("name", F.when(use, F.col("_s")).otherwise(F.col("_d")).alias("value"), F.when(use, "stored").otherwise("default").alias("origin"))


def bootstrapped(users: DataFrame, wanted: DataFrame, admin: str) -> DataFrame:
    """users (username, is_superuser) with the wanted names that are not there; the default administrator alone is superuser."""
    more = wanted.select("username").distinct().join(users.select("username"), "username", "left_anti").withColumn("is_superuser", F.lit(False))
    return users.unionByName(more).withColumn("is_superuser", F.col("username") == admin)


def roles(user: str = "") -> dict[str, Column]:
    """Guards over a user's row: each asks for what the one before asks for, too."""
    c = lambda n: F.coalesce(F.col(f"{user}{n}"), F.lit(False))
    signed = c("is_active")
    ready = signed & ~c("must_change_password")
    admin = ready & (c("is_admin") | c("is_superuser"))
    return {"signed_in": signed, "ready": ready, "admin": admin, "superuser": admin & c("is_superuser")}


# ---- documents and versions


def object_keys(keys: DataFrame, prefix: str) -> DataFrame:
    """(key, source): Markdown objects below a prefix, with the part after it, in order of keys. Slashes around the prefix do not matter."""
    p = prefix.strip("/")
    head = f"{p}/" if p else ""
    rows = keys.filter(F.col("key").startswith(head) & F.lower("key").endswith(".md"))
    return rows.select("key", F.substring("key", F.lit(len(head) + 1), F.length("key")).alias("source"))


def versioned_text(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, version_id, text): the exact version where one is named, else the latest. objects: key, version_id, modified, text."""
    latest = objects.groupBy("key").agg(F.max_by(F.struct("version_id", "text"), "modified").alias("_l"))
    exact = objects.select("key", "version_id", F.col("text").alias("_t"))
    rows = wanted.join(exact, ["key", "version_id"], "left").join(latest, "key", "left")
    named = F.col("version_id").isNotNull()
    return rows.select("key", F.when(named, F.col("version_id")).otherwise(F.col("_l.version_id")).alias("version_id"), F.when(named, F.col("_t")).otherwise(F.col("_l.text")).alias("text"))


def recovered(versions: DataFrame, active: str | None, target: str) -> str | None:
    """The version whose manifest is the active one: the alias' target wins over a pointer that is missing or names another. versions: version, collection."""
    row = versions.filter(F.col("collection") == target).agg(F.max("version").alias("v")).first()
    return row["v"] if row["v"] is not None else active


def document_id(bucket: Column, key: Column) -> Column:
    return name_uuid(URL_NAMESPACE, F.concat(F.lit("s3://"), bucket, F.lit("/"), key))


def chunk_point_id(doc_id: Column, version_id: Column, etag: Column, digest: Column, index: Column) -> Column:
    """The id of a chunk of one version of a document: its version id, else its tag, else its digest."""
    version = F.coalesce(*[F.nullif(c, F.lit("")) for c in (version_id, etag, digest)])
    return name_uuid(URL_NAMESPACE, F.concat_ws(":", doc_id, version, index.cast("string")))


def display_source(path: Column, project: str, docs: str) -> Column:
    """A path relative to the project, else to the folder of documents, else its last part; slashes forward."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    below = lambda root: F.when(p.startswith(root.rstrip("/") + "/"), F.substring(p, F.lit(len(root.rstrip("/")) + 2), F.length(p)))
    return F.coalesce(below(project), below(docs), F.element_at(F.split(p, "/"), -1))


def signature_number(parts: list[Column]) -> Column:
    """The first twelve hex digits of a digest of parts, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12), 16, 10).cast("long")


#: Names at a root that make it a repository.
MARKERS = [".git", "pyproject.toml", "setup.py", "CMakeLists.txt", "package.json", "go.mod", "Cargo.toml"]


def discovered(files: DataFrame, root: str, explicit: str | None = None) -> DataFrame:
    """(place, repository): the repositories among files (path, relative to the root, and language, null for what is no code).

    An explicit folder is one repository. A root with a marker, or with code of its own, is one. Otherwise each folder below it that
    is not hidden and holds code outside hidden folders is one, in order of their names whatever the case; without any the root is one.
    """
    spark = files.sparkSession
    alone = lambda name: spark.createDataFrame([(1, name)], "place int, repository string")
    if explicit is not None:
        return alone(explicit)
    first, deep = F.substring_index("path", "/", 1), F.contains("path", F.lit("/"))
    if not files.filter(first.isin(MARKERS) | (~deep & F.col("language").isNotNull())).isEmpty():
        return alone(root)
    shown = files.filter(deep & F.col("language").isNotNull() & ~F.col("path").rlike(r"(^|/)\."))
    names = shown.select(first.alias("repository")).distinct()
    if names.isEmpty():
        return alone(root)
    rows = names.withColumn("_k", F.lower("repository")).repartitionByRange("_k", "repository").sortWithinPartitions("_k", "repository")
    numbered = stored(rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("_k", "repository"))))
    starts, n = [], 0
    for r in numbered.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():  # a row for each task
        starts.append((r["_p"], n))
        n += r["n"]
    out = stored(numbered.join(spark.createDataFrame(starts, "_p int, _b long"), "_p").select((F.col("_i") + F.col("_b")).cast("int").alias("place"), "repository"))
    drop(numbered)
    return out


def repositories(paths: DataFrame, fallback: str) -> DataFrame:
    """(repository, n): repositories below a root by the first part of the relative paths of code files; hidden ones go, files at the root belong to the fallback."""
    first = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(F.lit(fallback))
    return paths.withColumn("repository", first).filter(~F.col("repository").startswith(".")).groupBy("repository").agg(F.count("*").alias("n"))


def manifest_payload(documents: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, document_count, documents): the documents of each version as JSON, in order of their first column."""
    one = F.sort_array(F.collect_list(F.struct(*columns)))
    return documents.groupBy(by).agg(F.count("*").alias("document_count"), F.to_json(one).alias("documents"))


# ---- load


def batch_growth(counters: DataFrame, by: str, order: str) -> DataFrame:
    """(by, requests, batches, mean_batch) from counters at the beginning and the end. counters: requests, batches so far."""
    ends = counters.groupBy(by).agg(*[(F.max_by(c, order) - F.min_by(c, order)).alias(c) for c in ("requests", "batches")])
    return ends.withColumn("mean_batch", F.round(F.coalesce(F.try_divide(F.col("requests").cast("double"), F.col("batches")), F.lit(0.0)), 6))


def backlog(samples: DataFrame, by: str, at: str, waiting: str) -> DataFrame:
    """(by, peak, mean, slope) of how many events wait."""
    return samples.groupBy(by).agg(F.max(waiting).alias("peak"), F.round(F.avg(waiting), 6).alias("mean"), F.round(F.coalesce(F.regr_slope(waiting, at), F.lit(0.0)), 6).alias("slope"))


def archived_message(payload: Column) -> Column:
    """A message from JSON: the sequence number as id where there is one, contexts also from a JSON text, defaults for what is missing."""
    kind = "id long, session_seq long, role string, content string, contexts string, used_rag boolean"
    m = F.from_json(payload, kind)
    contexts = F.from_json(m["contexts"], "array<struct<source: string, text: string, score: double>>")
    return F.struct(F.coalesce(m["session_seq"], m["id"]).alias("id"), F.coalesce(m["role"], F.lit("user")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), F.coalesce(m["used_rag"], F.lit(False)).alias("used_rag"), F.coalesce(F.size(contexts), F.lit(0)).alias("n_contexts"))


def strip_literal(text: Column) -> Column:
    """A Python string literal's content: prefix letters and quotes, three or one, taken off."""
    bare = F.regexp_replace(strip(text), r"^[rRbBuUfF]{0,2}(?=[\"'])", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^(\"\"\"|'''|\"|')", ""), r"(\"\"\"|'''|\"|')$", "")


def node_id(repository: Column, name: Column) -> Column:
    return F.concat_ws(":", repository, name)
