"""Windowed totals of an event stream, with late events up to a watermark: the trailing windows of the marts, live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need an instant; times without a zone are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_totals(events: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Per window and event type: start, events, errors, total value. ``events`` may be a stream or a table."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    totals = _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return totals.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def last_per_user(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Per user the running count and the last observed value by event time, as a stream in complete or update mode."""
    seen = F.when(F.col("value").isNotNull(), F.col("ts"))
    return _timed(events, late).groupBy("user_id").agg(F.count("*").alias("events"), F.max_by("value", seen).alias("last_value"))
