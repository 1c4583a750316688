"""A monitor of many runs at once, as an operator of a stream of log lines: metric lines once each, and for each run how it ended: done, failed, or out of time.

The state of a run is kept by Spark: its first line's time, the first marker of an end, and the metric lines seen. Timers in event time decide: one at the first marker, one when the run's time is over. They fire when
the watermark has passed them, so what is told does not depend on the order in which lines arrive, and nothing polls. ``keep`` after its end a run's state is cleared.

On a batch the same rows come from aggregates: what a stream of the same lines has told when it has seen them all. A stream needs the state store provider ``PROVIDER``.

Defined cases: lines without a run or a time are left out; a line without text only starts its run; repeated lines, as polls repeat them, are one; of markers at the same time a failure comes first; a marker after the run's time
is too late."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.session import ship
from tessera.streaming.metrics import DONE, FAILED

#: The state store that timers need (``spark.sql.streaming.stateStore.providerClass``).
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a line of measures has in it.
METRIC = "METRICS "

_TOLD = "run string, kind string, time timestamp, value string, metrics long"


def _micros(time: pd.Timestamp) -> int:
    return time.value // 1000


class RunMonitor(StatefulProcessor):
    """Rows (run, time, value) of a run to rows (run, kind, time, value, metrics). Times are kept in microseconds."""

    def __init__(self, timeout_s: float, keep_s: float):
        self.timeout, self.keep = int(timeout_s * 1e6), int(keep_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "started long, marker long, kind string, ended boolean")
        self.seen = handle.getMapState("seen", "line string", "time long")

    def _timer(self, micros: int) -> int:
        return -(-micros // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, marker, kind, ended = self.run.get() if self.run.exists() else (None, None, None, False)
        before, told = (started, marker), []
        for frame in rows:
            for time, value in zip(frame["time"], frame["value"], strict=True):
                at, value = _micros(time), value or ""
                started = at if started is None else min(started, at)
                for found, text in (("failed", FAILED), ("done", DONE)):
                    # of equal times the failure
                    if text in value and (marker is None or (at, found != "failed") < (marker, kind != "failed")):
                        marker, kind = at, found
                name = f"{at} {value}"
                if METRIC in value and not self.seen.containsKey((name,)):
                    self.seen.updateValue((name,), (at,))
                    told.append((key[0], "metrics", time, value, None))
        if not ended:
            for old, new in zip((before[0] and before[0] + self.timeout, before[1]), (started + self.timeout, marker), strict=True):
                if new is not None and new != old:
                    if old is not None:
                        self.handle.deleteTimer(self._timer(old))
                    self.handle.registerTimer(self._timer(new))
        self.run.update((started, marker, kind, ended))
        if told:
            yield pd.DataFrame(told, columns=["run", "kind", "time", "value", "metrics"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.run.exists():
            return
        started, marker, kind, ended = self.run.get()
        if ended:
            self.run.clear()
            self.seen.clear()
            return
        deadline = started + self.timeout
        at, how = (marker, kind) if marker is not None and marker <= deadline else (deadline, "timeout")
        n = sum(1 for (seen,) in self.seen.values() if seen <= at)
        for left in {self._timer(deadline), *([self._timer(marker)] if marker is not None else [])} - {expiredTimerInfo.getExpiryTimeInMs()}:
            self.handle.deleteTimer(left)
        self.run.update((started, marker, kind, True))
        self.handle.registerTimer(self._timer(at + self.keep))
        yield pd.DataFrame([(key[0], how, pd.Timestamp(datetime.fromtimestamp(at // 1_000_000, timezone.utc).replace(microsecond=at % 1_000_000, tzinfo=None)), None, n)], columns=["run", "kind", "time", "value", "metrics"])

    def close(self) -> None:
        pass


def _seconds(interval: str) -> float:
    return pd.Timedelta(interval).total_seconds()


def monitored(lines: DataFrame, run: str = "run", time: str = "time", value: str = "value", timeout: str = "10 minutes", late: str = "1 minute", keep: str = "1 day") -> DataFrame:
    """(run, kind, time, value, metrics) of a batch or a stream of log lines. kind ``metrics``: a line of measures, with its time and text; ``done``, ``failed`` or ``timeout``: a run's end,
    with the number of its different metric lines up to then. late: how long lines may be late; what a watermark so far behind the last line has not passed is not told."""
    rows = lines.select(F.col(run).cast("string").alias("run"), F.col(time).cast("timestamp").alias("time"), F.col(value).alias("value")).where("run is not null and time is not null")
    if not lines.isStreaming:
        return _monitored_batch(rows, timeout, late)
    ship(lines.sparkSession)
    own = rows.withWatermark("time", late).groupBy("run")
    return own.transformWithStateInPandas(RunMonitor(_seconds(timeout), _seconds(keep)), outputStructType=_TOLD, outputMode="Append", timeMode="eventTime")


def _monitored_batch(rows: DataFrame, timeout: str, late: str) -> DataFrame:
    has = lambda text: F.coalesce(F.contains("value", F.lit(text)), F.lit(False))
    metric = rows.where(has(METRIC)).distinct()
    kind: Column = F.when(has(FAILED), "failed").when(has(DONE), "done")
    marker = F.min(F.when(kind.isNotNull(), F.struct("time", F.when(kind == "failed", 0).otherwise(1).alias("order"), kind.alias("kind")))).alias("marker")
    runs = rows.groupBy("run").agg(F.min("time").alias("started"), marker).withColumn("deadline", F.col("started") + F.expr(f"interval {timeout}"))
    timely = F.coalesce(F.col("marker.time") <= F.col("deadline"), F.lit(False))
    ends = runs.select("run", F.when(timely, F.col("marker.kind")).otherwise("timeout").alias("kind"), F.when(timely, F.col("marker.time")).otherwise(F.col("deadline")).alias("end"))
    horizon = rows.agg((F.max("time") - F.expr(f"interval {late}")).alias("horizon"))
    ends = ends.join(F.broadcast(horizon)).where(F.col("end") <= F.col("horizon"))  # one row
    counts = ends.join(metric.select("run", F.col("time").alias("at")), "run", "left").groupBy("run", "kind", "end").agg(F.count_if(F.col("at") <= F.col("end")).alias("metrics"))
    told = counts.select("run", "kind", F.col("end").alias("time"), F.lit(None).cast("string").alias("value"), "metrics")
    return metric.select("run", F.lit("metrics").alias("kind"), "time", "value", F.lit(None).cast("long").alias("metrics")).unionByName(told)
