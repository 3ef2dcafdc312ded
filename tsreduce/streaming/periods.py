"""Profiles of a stream: events summed into hours, which are split into periods as a table's are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsreduce.operators.reshape import period_of, step_of


def hourly_profiles(events: DataFrame, origin: str, period_length: int = 24, *, late: str = "2 hours") -> DataFrame:
    """(period, timestep, id, value) of (ts, event_type, value), for tables and streams; a stream's rows count until they are `late`."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("id"), "value")
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    hours = rows.groupBy(F.window("ts", "1 hour").alias("w"), "id").agg(F.sum("value").alias("value"))
    hour = F.floor((F.col("w.start").cast("long") - F.lit(origin).cast("timestamp").cast("long")) / 3600).cast("long") + 1
    return hours.select(period_of(hour, period_length).alias("period"), step_of(hour, period_length).alias("timestep"), "id", "value")
