"""Metric lines as a stream: the batch reader's rows, without repeated runs, up to the marker of the end, and counted in windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, key: str, value: str, every: str = "30 seconds", late: str | None = "10 minutes") -> DataFrame:
    """(start, key, n, total) by window; works on a batch and on a stream alike. late: how long rows may be late; None if the stream says so already."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    found = rows.groupBy(F.window(time, every), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("window.start").alias("start"), key, "n", "total")


# The markers of a finished and of a failed benchmark.
DONE, FAILED = "DEPLOYMENT_BENCHMARK_COMPLETE", "DEPLOYMENT_BENCHMARK_ERROR"


def distinct_runs(rows: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each run once, however often a log that is polled repeats its line. On a stream, repeats are known as long as the watermark keeps them."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


class Monitor:
    """Collects the metric lines of a stream of log lines (time, value) into a table in memory-independent form, a Parquet folder, until the marker of the end is seen.

    ``step`` takes a micro-batch: it appends the batch's metric lines, and notes the markers. A failure marker makes ``watch`` raise."""

    def __init__(self, path: str, time: str = "time"):
        self.path, self.time, self.state = path, time, "running"

    def step(self, batch: DataFrame, number: int) -> None:
        from tessera.sources.readers import metric_lines

        # a batch that is run again after a failure writes over its own folder
        metric_lines(batch).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        seen = batch.agg(F.max(F.contains("value", F.lit(DONE))).alias("done"), F.max(F.contains("value", F.lit(FAILED))).alias("failed")).first()
        if seen["failed"]:
            self.state = "failed"
        elif seen["done"] and self.state == "running":
            self.state = "done"

    def watch(self, lines: DataFrame, checkpoint: str, timeout: float = 600.0, every: float = 0.5) -> str:
        """Run until a marker comes, or ``timeout`` seconds have passed; the state at the end: ``done``, or a RuntimeError or TimeoutError."""
        import time

        query = lines.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).start()
        began = time.monotonic()
        try:
            while self.state == "running" and time.monotonic() - began < timeout:
                if not query.isActive:
                    query.awaitTermination()
                    break
                time.sleep(every)
        finally:
            query.stop()
        if self.state == "failed":
            raise RuntimeError("the benchmark reported an error")
        if self.state == "running":
            raise TimeoutError(f"no marker of the end after {timeout} seconds")
        return self.state
