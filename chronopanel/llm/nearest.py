"""Matching records by nearest time, by tick expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.asof import capture_date, valid_timestamp


def nearest_by_ticks(left: DataFrame, right: DataFrame, entity: str, left_date: str, right_date: str, payload: str, tolerance: int, tick_days: int = 128) -> DataFrame:
    """Nearest right row within ``tolerance`` days by tick expansion; at equal distance the greater ``payload``.

    Right rows are first reduced to the greatest payload for each entity and date, then put on every tick of ``tick_days`` days that lies
    within tolerance. An entity's tick keeps, of the dates before and after it, the nearest one each, and all dates inside (at most
    ``tick_days``), so it holds the answer for every left date in it, however many rows the entity has. Left rows then join their own tick by
    equality. Left columns are kept, equal left rows come once, ``payload`` and ``distance`` added; left rows without match are dropped. Null entities, dates and
    payloads never match. With ``tick_days=1`` a tick is one day and keeps one row.
    """
    right = right.select(F.col(entity).alias("_e"), F.unix_date(F.col(right_date)).alias("_d"), F.col(payload).alias("_p")).where("_e is not null and _d is not null and _p is not null")
    right = right.groupBy("_e", "_d").agg(F.max("_p").alias("_p"))
    width = F.lit(tick_days)
    tick = lambda d: F.floor(d / width).cast("int")
    spread = right.withColumn("_t", F.explode(F.sequence(tick(F.col("_d") - tolerance), tick(F.col("_d") + tolerance))))
    first = F.col("_t") * width
    side = F.when(F.col("_d") < first, -1).when(F.col("_d") >= first + width, -2).otherwise(F.col("_d") - first)
    away = F.abs(F.col("_d") - first)
    kept = spread.groupBy("_e", "_t", side.alias("_s")).agg(F.min_by(F.struct("_d", "_p"), away).alias("_r"))
    own = left.withColumn("_ld", F.unix_date(F.col(left_date)))
    both = own.withColumn("_t", tick(F.col("_ld"))).join(kept.withColumnRenamed("_e", entity), [entity, "_t"])
    gap = F.abs(F.col("_r._d") - F.col("_ld"))
    best = both.where(gap <= tolerance).groupBy(*left.columns).agg(F.max_by(F.struct(F.col("_r._p").alias("p"), gap.alias("g")), F.struct((-gap).alias("a"), F.col("_r._p").alias("b"))).alias("_best"))
    return best.select(*left.columns, F.col("_best.p").alias(payload), F.col("_best.g").cast("int").alias("distance"))


def found(snapshots: DataFrame, captures: DataFrame, tolerance: int = 548) -> DataFrame:
    """``firm_id, relative_timepoint, archive_timestamp`` of every observation that isn't future, matched by :func:`nearest_by_ticks`."""
    left = snapshots.where(~F.col("observation_is_future")).select("firm_id", "relative_timepoint", "target_date").distinct()
    usable = captures.where((F.col("statuscode") == "200") & (F.col("mimetype") == "text/html") & valid_timestamp(F.col("timestamp")))
    right = usable.select("firm_id", F.col("timestamp").alias("archive_timestamp"), capture_date(F.col("timestamp")).alias("capture_date"))
    return nearest_by_ticks(left, right, "firm_id", "target_date", "capture_date", "archive_timestamp", tolerance).select("firm_id", "relative_timepoint", "archive_timestamp").distinct()
