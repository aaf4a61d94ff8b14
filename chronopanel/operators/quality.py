"""Page checks, duplicate flags, coverage summary, review sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Quality
from ..functions import text as tx
from ..functions import urls

FLAGS = ["soft_404_flag", "likely_navigation_only", "duplicate_content_flag"]


def check_pages(pages: DataFrame, expected_domain: Column, config: Quality) -> DataFrame:
    """Checked pages: the stored flags, usable_for_analysis, exclusion_reason (first rule that holds) and ``quality_flags`` (all that hold).

    Rules in order: fetch error, status 400 or more, other domain, no text, error page. Text shorter than the least length makes a page
    unusable without a reason. Nulls never make a rule hold, but null text is empty text.
    """
    text = F.coalesce("extracted_text", F.lit(""))
    chars = F.coalesce("character_count", F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    error = yes(F.col("fetch_error") != "")
    status = yes(F.col("http_status") >= 400)
    domain = yes((F.col("registrable_domain") != "") & (F.col("registrable_domain") != expected_domain))
    far = yes(F.col("temporal_distance_days") > config.max_temporal_distance_days)
    short = chars < config.min_text_chars
    soft = tx.soft_404(text, F.col("document_title"))
    menu = tx.menu_only(text)
    toolbar = yes(F.col("archive_toolbar_removed_flag"))
    leak = urls.is_archive_url(F.col("final_url")) & yes(F.col("registrable_domain") == urls.ARCHIVE_HOST)
    reason = F.coalesce(
        F.when(error, F.col("fetch_error")), F.when(status, F.concat(F.lit("http_"), F.col("http_status").cast("string"))), F.when(domain, "wrong_registrable_domain"),
        F.when(chars == 0, "empty_text"), F.when(soft, "soft_404"),
    )
    named = {"fetch_error": error, "http_error": status, "wrong_domain": domain, "distant_snapshot": far, "short_text": short, "soft_404": soft, "navigation_only": menu, "toolbar_stripped": toolbar, "wayback_domain_leak": leak}
    usable = ~(error | status | domain | (chars == 0) | soft | leak) & ~short
    return pages.withColumns({
        "quality_flags": F.array_compact(F.array(*[F.when(c, n) for n, c in named.items()])), "duplicate_content_flag": F.lit(False), "soft_404_flag": soft,
        "likely_navigation_only": menu, "usable_for_analysis": usable, "exclusion_reason": reason,
    })


def flag_duplicates(pages: DataFrame, key: list[str], order: list[str], content: str = "content_hash") -> DataFrame:
    """Flag all but the first page of each content over the whole run; they become unusable for ``duplicate_content``.

    Only hashes and orders are aggregated (one minimum for each hash, combined before the shuffle, so a hot hash costs nothing); the wide rows
    are joined once with the hashes that occur more than once. Null content is never a duplicate. ``order`` must be total.
    """
    rank = F.struct(*order, *key)
    first = pages.where(F.col(content).isNotNull()).groupBy(F.col(content).alias("_h")).agg(F.min(rank).alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    both = pages.join(first, pages[content] == first["_h"], "left")
    again = F.coalesce(F.col("_first") != rank, F.lit(False))
    out = both.withColumn("_again", again)
    if "usable_for_analysis" in pages.columns:
        out = out.withColumn("usable_for_analysis", F.col("usable_for_analysis") & ~F.col("_again")).withColumn("exclusion_reason", F.when(F.col("_again"), "duplicate_content").otherwise(F.col("exclusion_reason")))
    return out.withColumn("duplicate_content_flag", F.col("_again")).drop("_again", "_h", "_first")


def summarize(snapshots: DataFrame, pages: DataFrame) -> DataFrame:
    """Coverage of each snapshot: pages are aggregated first, then joined, so a snapshot without pages counts 0."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    per = pages.groupBy("firm_id", "relative_timepoint").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if((F.col("http_status") == 200) & (F.coalesce("fetch_error", F.lit("")) == "")).alias("success"), F.count_if(yes("usable_for_analysis")).alias("usable"),
        F.avg(F.when(F.col("character_count") != 0, F.col("character_count"))).alias("chars"), *[F.max(yes(f)).alias(f) for f in FLAGS],
    )
    flags = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f), f) for f in FLAGS])))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return snapshots.join(per, ["firm_id", "relative_timepoint"], "left").select(
        "run_id", "firm_id", "rank", "company", "relative_timepoint", "target_year", "snapshot_status", zero("attempted").alias("pages_attempted"), zero("success").alias("pages_success"),
        zero("usable").alias("pages_usable"), (zero("attempted") - zero("usable")).alias("pages_excluded"), F.round(F.coalesce("chars", F.lit(0.0)), 1).alias("avg_text_chars"), F.when(F.size(flags) > 0, F.to_json(flags)).alias("flags"),
    )


def review_sample(pages: DataFrame, size: int = 15, seed: int = 42, key: tuple[str, ...] = ("firm_id", "relative_timepoint", "original_archived_url")) -> DataFrame:
    """A repeatable sample without replacement: the pages with the smallest seeded hash, of the usable ones if there are enough, else of all."""
    enough = pages.where(F.coalesce("usable_for_analysis", F.lit(False))).limit(size).count() >= size
    pool = pages.where(F.coalesce("usable_for_analysis", F.lit(False))) if enough else pages
    draw = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key], F.lit(str(seed))), 256)
    flags = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.col(f), F.lit(False)), f) for f in FLAGS])), ",")
    chosen = pool.orderBy(draw, *key).limit(size)
    return chosen.select(
        "run_id", "firm_id", "company", "relative_timepoint", "target_year", "original_archived_url", "wayback_replay_url", F.substring(F.coalesce("extracted_text", F.lit("")), 1, 2000).alias("extracted_text"),
        "usable_for_analysis", "exclusion_reason", flags.alias("quality_flags"), *[F.lit(None).cast("string").alias(c) for c in ("valid_page", "relevant_corporate_content", "extraction_correct", "notes")],
    )
