"""Queries over event streams: the same builder on a streaming source, with windows and watermarks."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, width: str, by: list[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Rows per window and group: ``start``, ``end``, the group's columns and ``n``. ``late`` bounds how long a window waits for stragglers."""
    if late and events.isStreaming:
        events = events.withWatermark(time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def session_counts(events: DataFrame, time: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """Rows per group and session, which ends when nothing has come for ``gap``: ``start``, ``end``, the group's columns and ``n``."""
    if late and events.isStreaming:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", format: str = "parquet") -> Any:
    """Writes what there is of a stream and stops; going on later takes up at ``checkpoint``."""
    out = stream.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    out.awaitTermination()
    return out
