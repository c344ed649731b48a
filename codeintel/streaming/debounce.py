"""Bursts of change events: one refresh a burst, in batch or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def bursts(events: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    """(key, start, stop, n): events of a key closer than ``gap`` are one burst."""
    w = F.session_window(ts, gap)
    return events.groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def refresh_stream(events: DataFrame, key: str, gap: str, refresh: Callable[[DataFrame, int], None], checkpoint: str, late: str = "10 minutes") -> StreamingQuery:
    """Call ``refresh`` with the closed bursts of each micro-batch; batches never overlap."""
    closed = bursts(events.withWatermark("ts", late), key, gap)
    return closed.writeStream.outputMode("append").foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
