"""A growing capture index as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof


def distinct_captures(stream: DataFrame, delay: str = "30 days", time: str = "arrived_at") -> DataFrame:
    """First arrival of every (firm_id, timestamp, original) within ``delay``; state of older keys is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["firm_id", "timestamp", "original"])


def captures_by_month(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Captures with a valid timestamp for each firm and 30 days of capture time; rows later than ``delay`` are dropped."""
    timed = stream.where(asof.valid_timestamp(F.col("timestamp"))).withColumn("captured_at", F.to_timestamp("timestamp", "yyyyMMddHHmmss"))
    per = timed.withWatermark("captured_at", delay).groupBy(F.window("captured_at", "30 days"), "firm_id").agg(F.count(F.lit(1)).alias("captures"))
    return per.select("firm_id", F.col("window.start").alias("from_time"), "captures")
