"""A circuit breaker of each service: it opens at so many failures in a row, and closes at a success or after a while without a failure.

`breaker` keeps it as state of a stream, so it lasts over batches and restarts; `breaker_log` says the same of a table of events.

Rows: service, kind (`opened` with the failure that did it; `closed` with the run's last failure), at, and length of the run so far.
Events of a service are put in order within a batch; those of later batches should be later. A service's events of one batch are
one task's work, in Arrow batches: bound a batch by the source (maxFilesPerTrigger), as each failure depends on the one before.

Cases: a null service is one of its own in a table, and has no state in a stream; events without a time are left out; a run that is still open gives
no `closed` row; an event that is no failure and not known to be one (null) counts as a success.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "service string, kind string, at_ms long, length int"


class Breaker(StatefulProcessor):
    """State: failures in a row and the time of the last. A timer stands at that time and `cool` for a breaker that is open or about to be."""

    def __init__(self, most: int, cool_ms: int):
        self.most, self.cool_ms = most, cool_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "length int, last long")

    def _rows(self, key, found: list[tuple]):
        import pandas as pd

        return pd.DataFrame([(key[0], *f) for f in found], columns=["service", "kind", "at_ms", "length"]).astype({"at_ms": "int64", "length": "int32"})

    def _set(self, before: int | None, length: int, last: int | None) -> None:
        if before is not None:
            self.handle.deleteTimer(before + self.cool_ms + 1)
        if length:
            self.run.update((length, last))
            self.handle.registerTimer(last + self.cool_ms + 1)
        elif before is not None:
            self.run.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        length, last = self.run.get() if self.run.exists() else (0, None)
        before, found = last, []
        events = pd.concat(list(rows)).sort_values(["at_ms", "tie"])
        for at, failed in zip(events["at_ms"].tolist(), events["failed"].tolist()):
            if length and (not failed or at - last > self.cool_ms):
                if length >= self.most:
                    found.append(("closed", last, length))
                length = 0
            if failed:
                length, last = length + 1, at
                if length == self.most:
                    found.append(("opened", at, length))
        self._set(before, length, last)
        if found:
            yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.run.exists():
            length, last = self.run.get()
            if last + self.cool_ms < expiredTimerInfo.getExpiryTimeInMs():
                self.run.clear()
                if length >= self.most:
                    yield self._rows(key, [("closed", last, length)])

    def close(self) -> None:
        pass


def _events(events: DataFrame, service: str, time: str, tie: Column, failed: Column) -> DataFrame:
    return events.where(F.col(time).isNotNull()).select(F.col(service).cast("string").alias("service"), F.col(time).alias("time"), F.unix_millis(time).alias("at_ms"), tie.cast("long").alias("tie"), F.coalesce(failed, F.lit(False)).alias("failed"))


def breaker(events: DataFrame, service: str, time: str, tie: Column, failed: Column, late: str, most: int = 3, cool: int = 3_600_000) -> DataFrame:
    """The rows of a stream's breakers. `late`: how late events may be; `cool`: milliseconds after which a failure is forgotten. Needs the state store of RocksDB."""
    rows = _events(events, service, time, tie, failed).where("service is not null").withWatermark("time", late)
    found = rows.groupBy("service").transformWithStateInPandas(Breaker(most, cool), OUT, "Append", "EventTime")
    return found.select("service", "kind", F.timestamp_millis("at_ms").alias("at"), "length")


def breaker_log(events: DataFrame, service: str, time: str, tie: Column, failed: Column, most: int = 3, cool: int = 3_600_000, until: Column | None = None) -> DataFrame:
    """The same of a table, in two passes of windows over a service. `until`: a time up to which quiet is known; without it only a later event closes the last run."""
    rows = _events(events, service, time, tie, failed)
    w = Window.partitionBy("service").orderBy("at_ms", "tie")
    last = F.lag(F.when(F.col("failed"), F.col("at_ms"))).over(w)
    new = ~F.col("failed") | last.isNull() | (F.col("at_ms") - last > cool)
    rows = rows.withColumn("next", F.lead("at_ms").over(w)).withColumn("run", F.count_if(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("failed")
    place = Window.partitionBy("service", "run").orderBy("at_ms", "tie")
    rows = rows.withColumn("n", F.row_number().over(place))
    opened = F.min(F.when(F.col("n") == most, F.col("at_ms")))
    runs = rows.groupBy("service", "run").agg(F.count("*").cast("int").alias("length"), opened.alias("opened"), F.max("at_ms").alias("last"), F.max_by("next", F.struct("at_ms", "tie")).alias("next")).where(F.col("length") >= most)
    quiet = F.lit(False) if until is None else F.col("last") + cool < F.unix_millis(until)
    of = lambda kind, at, length: F.struct(F.lit(kind).alias("kind"), F.timestamp_millis(at).alias("at"), length.alias("length"))
    both = F.array_compact(F.array(of("opened", "opened", F.lit(most).cast("int")), F.when(F.col("next").isNotNull() | quiet, of("closed", "last", F.col("length")))))
    return runs.select("service", F.explode(both).alias("x")).select("service", "x.*")
