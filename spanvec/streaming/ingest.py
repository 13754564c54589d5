"""Streams: feeding a keyed store, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lookup import SidecarBuilder


def feed(stream: DataFrame, builder: SidecarBuilder, checkpoint: str):
    """A query that pushes each micro-batch into the builder; call ``finish`` on it after the stream ends.

    A batch that is run again after a failure takes the place of its first run.
    """
    return stream.writeStream.foreachBatch(builder.push).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "10 minutes", *by: str) -> DataFrame:
    """Events in tumbling windows, by further columns; in a stream, rows later than the watermark are dropped."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, every).alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key: runs of events with gaps shorter than ``gap``."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    w = F.session_window(time, gap).alias("w")
    return rows.groupBy(w, key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
