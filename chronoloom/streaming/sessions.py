"""Event-time streams: gap-separated activity by session windows, the same in batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """user_id, start, end, events, value of runs without a pause over gap.  late: a watermark, for streams.

    ts may be without time zone; it is taken as UTC wall time, since watermarks need a zoned type.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        e = e.withWatermark("ts", late)
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")


def windowed_counts(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")
