"""Telemetry as a stream: heartbeats folded per event-time window, late rows dropped after a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(stream: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, key, n and total of each tumbling window; works on a stream and on a table alike."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late) if stream.isStreaming else stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    out = rows.groupBy(F.window("_ts", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")
