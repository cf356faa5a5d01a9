"""The session store as a stream, against the batch operators and its own rules."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import sessions
from quillspark.streaming.health import health_stream
from quillspark.streaming.sessions import COMMAND, STORED, session_stream

NAMES = [c.split()[0] for c in COMMAND.split(", ")]


class Store:
    """Batches of commands through one query with its checkpoint; each run ends when all is read."""

    def __init__(self, spark, path, stored=None, **more):
        self.spark, self.path, self.stored, self.more, self.n = spark, path, stored, more, 0
        (path / "in").mkdir()

    def run(self, *commands):
        self.n += 1
        with open(self.path / f"{self.n}.tmp", "w") as f:
            f.writelines(json.dumps(c) + "\n" for c in commands)
        (self.path / f"{self.n}.tmp").rename(self.path / "in" / f"{self.n:03d}.json")
        out = self.path / "out"
        before = {r["x"] for r in self._rows()}
        rows = session_stream(self.spark.readStream.schema(COMMAND).json(str(self.path / "in")), self.stored, **self.more)
        q = rows.writeStream.format("parquet").option("checkpointLocation", str(self.path / "ck")).trigger(availableNow=True).start(str(out))
        assert q.awaitTermination(120)
        return [r for r in self._rows() if r["x"] not in before]

    def _rows(self):
        out = self.path / "out"
        if not out.exists() or not any(out.glob("*.parquet")):
            return []
        rows = self.spark.read.parquet(str(out)).withColumn("x", F.input_file_name())
        return sorted(rows.collect(), key=lambda r: (r["session_id"], r["seq"] or 0, r["kind"]))


def append(s, place, event, q="q", **more):
    return {"session_id": s, "place": place, "event_id": event, "kind": "append", "user_id": 1, "question": q, "answer": f"a {q}"} | more


def kinds(rows):
    return [(r["session_id"], r["kind"], r["seq"]) for r in rows]


@pytest.fixture
def few(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_commands(few, tmp_path):
    stored = few.createDataFrame([(5, 9, 4, "Old", "sum", 2)], STORED)
    s = Store(few, tmp_path, stored)
    one = s.run(append(1, 0, "e1", "one", title="  My   title "), append(5, 0, "f1"), append(1, 1, "e2", "two", summary="S", compacted=3), append(None, 0, "lost"), append(1, 1, "e2", "two"))
    assert kinds(one) == [(1, "message", 1), (1, "message", 2), (1, "message", 3), (1, "message", 4), (5, "message", 5), (5, "message", 6)]
    assert [(r["role"], r["content"], r["event_id"], r["title"]) for r in one[:2]] == [("user", "one", "e1:user", "My title"), ("assistant", "a one", "e1:assistant", "My title")]
    assert (one[3]["summary"], one[3]["compacted"], one[5]["title"], one[5]["summary"], one[5]["compacted"]) == ("S", 3, "Old", "sum", 2)
    # Delivered again, renamed by its owner and by another, listed.
    two = s.run(append(1, 0, "e1", "one"), {"session_id": 1, "place": 3, "event_id": "r1", "kind": "rename", "user_id": 1, "title": "zebra"}, {"session_id": 1, "place": 4, "event_id": "r2", "kind": "rename", "user_id": 1, "title": "apple"}, {"session_id": 5, "place": 1, "event_id": "r3", "kind": "rename", "user_id": 1, "title": "mine"}, {"session_id": 1, "place": 5, "event_id": "l1", "kind": "list"})
    assert kinds(two) == [(1, "rename", None), (1, "rename", None), (1, "listed", 1), (1, "listed", 2), (1, "listed", 3), (1, "listed", 4), (5, "refused", None)]
    assert {r["title"] for r in two if r["kind"] == "listed"} == {"apple"}  # the later one holds
    three = s.run({"session_id": 1, "place": 6, "event_id": "c", "kind": "clear"}, {"session_id": 1, "place": 7, "event_id": "l2", "kind": "list"}, append(1, 8, "e3", "three"), {"session_id": 5, "place": 2, "event_id": "d", "kind": "delete", "user_id": 9}, append(5, 3, "f2"))
    assert kinds(three) == [(1, "clear", None), (1, "miss", None), (1, "message", 5), (1, "message", 6), (5, "delete", None), (5, "refused", None)]


def test_messages_and_ids_expire(few, tmp_path):
    s = Store(few, tmp_path, ttl=6)
    s.run(append(1, 0, "e1"))
    assert kinds(s.run(append(1, 0, "e1"), {"session_id": 1, "place": 1, "event_id": "l", "kind": "list"})) == [(1, "listed", 1), (1, "listed", 2)]
    time.sleep(7)
    late = s.run({"session_id": 1, "place": 2, "event_id": "m", "kind": "list"}, append(1, 3, "e1"))
    assert kinds(late) == [(1, "miss", None), (1, "message", 3), (1, "message", 4)]  # numbers go on


def test_appends_as_the_batch_operator_has_them(few, tmp_path):
    rows = [(c, p, f"{c}-{p}", f"q{p}", f"a{p}") for c in range(4) for p in range(c + 1)]
    s = Store(few, tmp_path)
    got = s.run(*(append(c, p, e, q, answer=a) for c, p, e, q, a in rows))
    batch = sessions.appended(few.createDataFrame(rows, "session_id long, place long, event_id string, question string, answer string"), few.createDataFrame([], "session_id long, last_seq long"))
    names = [c for c in ("session_id", "seq", "role", "content") if c in batch.columns]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(map(tuple, batch.select(*names).collect())) and len(names) == 4


def test_health_as_the_batch_operator_has_it(few, tmp_path):
    r = random.Random(6)
    probes = [(f"c{c}", i, r.choice([True, True, False, None])) for c in range(4) for i in range(30)] + [("c9", 0, False), ("c9", 1, False), ("c9", 2, True), ("c9", 3, True)]
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for n in range(3):  # three micro-batches, of ten probes each
        with open(src / f"{n}.json", "w") as f:
            f.writelines(json.dumps({"component": c, "place": i, "ok": ok}) + "\n" for c, i, ok in probes if i // 10 == n)
        rows = health_stream(few.readStream.schema("component string, place long, ok boolean").json(str(src)))
        q = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out)
        assert q.awaitTermination(120)
    got = few.read.parquet(out)
    batch = sessions.hysteresis(few.createDataFrame(probes, "component string, place long, ok boolean"), "component", ["place"])
    names = ["component", "place", "degraded"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, batch.select(names).collect()))
    assert [(x["place"], x["degraded"]) for x in got.filter("component = 'c9' and changed").orderBy("place").collect()] == [(1, True), (3, False)]
