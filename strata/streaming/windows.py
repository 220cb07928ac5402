"""Event-time windows over an event stream or table: an extension that the catalog itself does not need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(rows: DataFrame, window: Column, by: str) -> DataFrame:
    sums = rows.groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value"))
    return sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "events", "value")


def tumbling(events: DataFrame, length: str = "1 hour", by: str = "event_type", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return _counted(rows, F.window("ts", length), by)


def sliding(events: DataFrame, length: str = "2 hours", slide: str = "1 hour", by: str = "event_type", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return _counted(rows, F.window("ts", length, slide), by)


def sessions(events: DataFrame, gap: str = "30 minutes", by: str = "user_id", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return _counted(rows, F.session_window("ts", gap), by)
