"""Streaming forms of the windowed operators; each works on a batch table as well.

Late rows: behind the watermark they are dropped, which is Spark's own policy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def _marked(rows: DataFrame, ts: str, late: str) -> DataFrame:
    return rows.withWatermark(ts, late) if rows.isStreaming else rows


def tumbling(rows: DataFrame, ts: str, length: str, value: str, keys: list[str] = (), late: str = "10 minutes") -> DataFrame:
    """Block means by time (the block average of a signal)."""
    return _marked(rows, ts, late).groupBy(F.window(ts, length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(*keys, F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "n", "mean")


def sliding(rows: DataFrame, ts: str, length: str, hop: str, value: str, keys: list[str] = (), late: str = "10 minutes") -> DataFrame:
    """Overlapping windows (analysis windows, overlapped chunks)."""
    return _marked(rows, ts, late).groupBy(F.window(ts, length, hop).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*keys, F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "n", "total")


def sessions(rows: DataFrame, ts: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows within ``gap`` of each other are one region."""
    return _marked(rows, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).select(*keys, "first_ts", "last_ts", "n")


def running_stats(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Counts and sums so far, for update mode."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def start(rows: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write a stream as Parquet; the checkpoint lets it go on after a lost driver."""
    return rows.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Calls ``report(name, batch, rows)`` after every batch of a stream."""

    def __init__(self, report):
        self.report = report

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.report(event.progress.name, event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
