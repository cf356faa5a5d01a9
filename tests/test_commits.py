"""Archive and sessions in one commit: seen together, once, whatever fails in between."""

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import archive
from quillspark.streaming.commits import CommittedTables

LINE = '{"event_id":"%s","session_id":%d,"seq":%d,"role":"user","content":"x"}'


def state(spark, root, stored):
    tables = CommittedTables(spark, root)
    rows = sorted((r["event_id"], r["seq"]) for r in tables.read("archive", f"{archive.EVENT}, bucket int").collect())
    return rows, dict(sorted(map(tuple, archive.archived_sessions(tables, stored).collect()))), tables.read("dead", "value string").count()


def test_a_failure_between_the_tables(spark, tmp_path, monkeypatch):
    src, root = tmp_path / "src", str(tmp_path / "tables")
    src.mkdir()
    stored = spark.createDataFrame([(1, 0), (2, 7)], "session_id long, archive_seq long")
    (src / "1.txt").write_text("\n".join([LINE % ("a", 1, 1), LINE % ("b", 1, 2), LINE % ("a", 1, 1), "broken", LINE % ("z", 9, 1)]))

    def go(name="q", checkpoint="ck"):
        q = archive.session_archive_stream(spark.readStream.text(str(src)), stored, root, str(tmp_path / checkpoint), name)
        q.awaitTermination(120)

    real = archive.CommittedTables.commit

    def broken(self, query, batch, tables, by=None):
        boom = F.udf(lambda x: 1 // 0, "long")
        return real(self, query, batch, tables | {"sessions": tables["sessions"].withColumn("archive_seq", boom("archive_seq"))}, by)

    monkeypatch.setattr(archive.CommittedTables, "commit", broken)
    with pytest.raises(Exception, match="ZeroDivision|division"):
        go()
    assert state(spark, root, stored) == ([], {1: 0, 2: 7}, 0)  # the archive's folder is there, and nobody sees it
    assert list((tmp_path / "tables" / "archive").iterdir())
    monkeypatch.setattr(archive.CommittedTables, "commit", real)
    go()
    assert state(spark, root, stored) == ([("a", 1), ("b", 2)], {1: 2, 2: 7}, 1)
    (src / "2.txt").write_text("\n".join([LINE % ("b", 1, 2), LINE % ("c", 1, 3), LINE % ("d", 2, 8)]))
    go()
    go(name="other", checkpoint="ck2")  # a lost checkpoint reads all again
    rows, sessions, _ = state(spark, root, stored)
    assert (rows, sessions) == ([("a", 1), ("b", 2), ("c", 3), ("d", 8)], {1: 3, 2: 8})


def test_a_batch_is_committed_once(spark, tmp_path):
    tables = CommittedTables(spark, str(tmp_path / "t"))
    one = {"x": spark.range(3), "y": spark.range(2)}
    assert tables.commit("q", 0, one) and not tables.commit("q", 0, one) and tables.commit("q", 1, {"x": spark.range(1)})
    assert sorted(map(tuple, tables.read("x", "id long").groupBy("_commit").count().collect())) == [(1, 3), (2, 1)]
    late = CommittedTables(spark, str(tmp_path / "t"))
    late.committed = lambda *a: False  # it has looked before the other one committed
    assert not late.commit("q", 1, {"x": spark.range(9)}) and tables.read("x", "id long").count() == 4
    assert len(list((tmp_path / "t" / "x").iterdir())) == 2
    assert tables.read("none", "id long").count() == 0
