"""Nearest-in-time joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Selection
from ..functions import urls


def capture_date(timestamp: Column) -> Column:
    """Date of a 14-digit timestamp's first eight digits; null if they are no date."""
    return F.when(F.length(timestamp) >= 8, F.try_to_timestamp(F.substring(timestamp, 1, 8), F.lit("yyyyMMdd")).cast("date"))


def valid_timestamp(timestamp: Column) -> Column:
    """Whether a string is 14 digits that name a moment."""
    return F.coalesce(timestamp.rlike("^[0-9]{14}$") & F.try_to_timestamp(timestamp, F.lit("yyyyMMddHHmmss")).isNotNull(), F.lit(False))


def nearest(left: DataFrame, right: DataFrame, on: Sequence[str], left_date: str, right_date: str, tolerance: int, order: Sequence[Column], tie_break: str = "later") -> DataFrame:
    """For each left row the nearest right row of the same entity: equi-join on ``on``, hash aggregation.

    Adds ``candidates`` (right rows of the entity), ``near`` (those within ``tolerance`` days) and ``best`` (struct of the right row, null if
    none is near). At equal distance the later date wins, or the earlier; at equal dates ``order``, smallest first. ``left`` must have a
    column ``_row`` that names its rows. Right rows without date never match, but are candidates. The right side is first reduced to one row
    for each entity and date, with map-side combination, so an entity brings at most as many rows to the join as there are days.
    """
    own = right.select(*on, F.struct("*").alias("r"))
    day = F.col(f"r.{right_date}")
    days = own.groupBy(*on, day.alias("_d")).agg(F.min_by("r", F.struct(*order)).alias("r"), F.count(F.lit(1)).alias("_n"))
    gap = F.abs(F.datediff(F.col(left_date), F.col("_d")))
    sign = -1 if tie_break == "later" else 1
    near = gap <= tolerance
    names = [c for c in left.columns if c not in (*on, "_row")]
    key = F.struct(gap.alias("g"), (F.unix_date("_d") * sign).alias("t"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return (
        left.join(days, list(on), "left").groupBy("_row", *on)
        .agg(*[F.first(c).alias(c) for c in names], zero("_n").alias("candidates"), zero(F.when(near, F.col("_n"))).alias("near"), F.min_by("r", F.when(near, key)).alias("best"))
    )


def select_captures(observed: DataFrame, captures: DataFrame, selection: Selection) -> DataFrame:
    """``observed`` with status, chosen capture, distance and reasons.

    Status: ``future_unavailable`` (target after the run date; captures aren't looked at), ``not_found`` (the entity has none),
    ``beyond_tolerance`` (none near enough), ``selected``. At equal distance the later capture wins unless ``tie_break`` is ``earlier``; on
    one date the first by (seed_ord, row_ord).
    """
    tol = selection.tolerance_days
    allowed = captures.where(F.col("statuscode").isin(*selection.allowed_status_codes) & F.col("mimetype").isin(*selection.allowed_mimetypes))
    dated = allowed.withColumn("capture_date", capture_date(F.col("timestamp"))).withColumn("_live", F.lit(True))
    own = observed.withColumn("_row", F.struct("firm_id", "relative_timepoint")).withColumn("_live", ~F.coalesce("observation_is_future", F.lit(False)))
    got = nearest(own, dated, ["firm_id", "_live"], "target_date", "capture_date", tol, [F.col("r.seed_ord"), F.col("r.row_ord")], selection.tie_break)
    best = F.col("best")
    status = F.when(F.col("observation_is_future"), "future_unavailable").when(F.col("candidates") == 0, "not_found").when(F.col("near") == 0, "beyond_tolerance").otherwise("selected")
    days = F.datediff(F.col("best.capture_date"), F.col("target_date"))
    reason = F.when(days == 0, "exact_date_match").otherwise(F.concat(F.lit(f"closest_within_{tol}d"), F.when(days < 0, "_earlier").otherwise("_later")))
    return got.drop("_row", "_live").select(
        *[c for c in observed.columns],
        status.alias("snapshot_status"), F.col("best.original").alias("canonical_original_url"), F.col("best.timestamp").alias("archive_timestamp"),
        F.col("best.capture_date").alias("selected_capture_date"), F.abs(days).alias("temporal_distance_days"),
        F.when(best.isNotNull(), urls.build_replay_url(F.col("best.original"), F.col("best.timestamp"))).alias("wayback_replay_url"),
        F.col("best.statuscode").alias("http_status"), F.col("best.mimetype").alias("mime_type"), F.col("best.digest").alias("digest"), F.col("best.redirect").alias("redirect_chain"),
        F.when(status == "future_unavailable", "future_unavailable").when(status == "selected", reason).alias("selection_reason"),
        F.when(status == "not_found", "no_matching_captures").when(status == "beyond_tolerance", f"nearest_capture_exceeds_{tol}_days").alias("failure_reason"),
    )
