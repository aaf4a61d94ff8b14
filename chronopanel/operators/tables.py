"""Keyed merges and placeholder rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` without the keys of ``fresh``, and ``fresh``; a column that one side lacks is null there. Null keys never match."""
    return existing.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def of_firms(df: DataFrame, firm_ids: list[str] | None) -> DataFrame:
    """Rows of the given firms, compared as strings; no list means all."""
    return df if firm_ids is None else df.where(F.col("firm_id").cast("string").isin([str(x) for x in firm_ids]))


def placeholders(snapshots: DataFrame) -> DataFrame:
    """A page row without page for every snapshot that isn't selected; its status is the reason for its exclusion."""
    return snapshots.where(F.col("snapshot_status") != "selected").withColumn("usable_for_analysis", F.lit(False)).withColumn("exclusion_reason", F.col("snapshot_status"))
