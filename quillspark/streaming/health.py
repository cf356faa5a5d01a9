"""Health of components over a stream of probes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .sessions import PROVIDER

OUT = "component string, place long, ok boolean, degraded boolean, changed boolean"


class _Health(StatefulProcessor):
    def __init__(self, failures: int, recoveries: int):
        self.failures, self.recoveries = failures, recoveries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getValueState("runs", "failed long, passed long, degraded boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        failed, passed, degraded = self.runs.get() or (0, 0, False)
        for r in sorted(rows, key=lambda r: (r.place is None, r.place or 0)):  # one component's part of a micro-batch
            failed = failed + 1 if r.ok is False else 0
            passed = passed + 1 if r.ok is True else 0
            before, degraded = degraded, (degraded or failed >= self.failures) and passed < self.recoveries
            yield Row(component=key[0], place=r.place, ok=r.ok, degraded=degraded, changed=degraded != before)
        self.runs.update((failed, passed, degraded))


def health_stream(probes: DataFrame, failures: int = 2, recoveries: int = 2) -> DataFrame:
    """probes (component, place, ok) with `degraded`, on after so many failures in a row and off after so many successes, and whether it changed.

    As sessions.hysteresis has it for a table; the runs go on from one micro-batch to the next. A probe without result ends both kinds of
    run and changes nothing; probes without component take no part. The RocksDB state store is set here.
    """
    probes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = probes.filter(F.col("component").isNotNull()).select("component", "place", "ok")
    return rows.groupBy("component").transformWithState(_Health(failures, recoveries), StructType.fromDDL(OUT), "append", "none")
