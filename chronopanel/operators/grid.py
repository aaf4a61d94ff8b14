"""Observations: every entity at every timepoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config


def first_n(firms: DataFrame, n: int | None, default: int) -> DataFrame:
    """The first ``n`` firms by rank; null and 0 mean ``default``. Ties keep the smaller firm_id."""
    order = [F.col("rank"), *([F.col("firm_id")] if "firm_id" in firms.columns else [])]
    return firms.orderBy(*order).limit(n or default)


def with_identity(firms: DataFrame, run_id: str) -> DataFrame:
    return firms.withColumn("firm_id", F.col("rank").cast("string")).withColumn("run_id", F.lit(run_id))


def observations(firms: DataFrame, config: Config) -> DataFrame:
    """One row for each firm and timepoint with target_year, target_date and observation_is_future.

    The timepoints are a literal array that is exploded in place: no join, no shuffle. A firm without event year has null targets.
    """
    month, day = (int(x) for x in config.selection.target_month_day.split("-"))
    points = F.array(*[F.struct(F.lit(t).alias("relative_timepoint"), F.lit(config.timepoints.year_offsets[t]).alias("offset")) for t in config.timepoints.relative])
    out = firms.withColumn("_tp", F.explode(points)).withColumn("relative_timepoint", F.col("_tp.relative_timepoint"))
    out = out.withColumn("target_year", F.col("event_year") + F.col("_tp.offset")).drop("_tp")
    out = out.withColumn("target_date", F.when(F.col("target_year").isNotNull(), F.make_date("target_year", F.lit(month), F.lit(day))))
    return out.withColumn("observation_is_future", F.col("target_date") > F.lit(config.run_date).cast("date"))
