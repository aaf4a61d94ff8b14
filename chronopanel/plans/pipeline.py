"""Stages of a panel run, each from tables to a table; one lazy plan from the firm list to the summary, but for the crawl's levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config
from ..functions import html, urls
from ..functions import text as tx
from ..operators import asof, captures, crawl, grid, quality, tables


def prepare(longlist: DataFrame, config: Config, top_n: int | None = None) -> DataFrame:
    """The firms of the run."""
    return schemas.conform(grid.with_identity(grid.first_n(longlist, top_n, config.top_n), config.run_id), schemas.FIRMS)


def discover(firms: DataFrame, index: DataFrame, config: Config, discovered_at: str, firm_ids: list[str] | None = None) -> DataFrame:
    """Snapshots: the chosen capture of every observation. ``index``: requested_url, row_ord and the capture columns."""
    own = tables.of_firms(firms, firm_ids)
    found = captures.by_variants(own, index, config.selection.url_variants)
    out = asof.select_captures(grid.observations(own, config), found, config.selection)
    tried = captures.attempts_json(captures.seeds(F.col("website"), F.col("primary_domain"), config.selection.url_variants))
    live = F.col("snapshot_status") != "future_unavailable"
    note = f"Year-level target dates use {config.selection.target_month_day} of the event year; the capture may lie before or after the event."
    out = out.withColumns({
        "capture_source": F.when(live, "capture_index"), "requested_url": F.when(live, F.col("website")), "fallback_attempts": F.when(live, tried),
        "event_year_precision_note": F.when(F.col("relative_timepoint") == "event", note), "discovered_at": F.lit(discovered_at).cast("timestamp"),
    })
    return schemas.conform(out, schemas.SNAPSHOTS)


_RESPONSE = ("fetch_error", "mime_type", "content_hash", "final_url", "fetch_timestamp", "redirect_chain")


def crawl_and_extract(snapshots: DataFrame, firms: DataFrame, fetched: DataFrame, config: Config) -> DataFrame:
    """Page rows of all snapshots. ``fetched``: firm_id, relative_timepoint, url, and what a response holds (http_status, content, mime_type,
    content_hash, fetch_error, final_url, fetch_timestamp)."""
    tag = F.concat_ws("|", "firm_id", "relative_timepoint")
    norm = lambda c: urls.normalize(c, config.crawl.strip_query_strings, config.crawl.exclude_query_patterns)
    missing = {n: F.lit(None).cast(t) for n, t in schemas.columns(schemas.PAGES) if n in _RESPONSE and n not in fetched.columns}
    own = fetched.withColumns(missing).withColumn("snapshot_id", tag).withColumn("url", norm(F.col("url"))).dropDuplicates(["snapshot_id", "url"])
    lookup = firms.groupBy("firm_id").agg(F.first("website").alias("website"), F.first("primary_domain").alias("primary_domain"))
    chosen = snapshots.where(F.col("snapshot_status") == "selected").withColumn("snapshot_id", tag).join(lookup, "firm_id")
    first = F.coalesce(F.nullif(F.col("canonical_original_url"), F.lit("")), F.col("website"))
    seeds = chosen.select("snapshot_id", norm(first).alias("url"), F.col("primary_domain").alias("domain"))
    links = html.links(own.select("snapshot_id", "content", "url"), ["snapshot_id", "url"]).withColumn("link", norm(F.col("link")))
    state = own.select("snapshot_id", "url", F.col("http_status").alias("status"), (F.length("content") > 0).alias("has_content"))
    visited = crawl.traverse(seeds, state, links, config.crawl).withColumn("_seq", F.col("fetch_seq"))
    return page_rows(chosen, visited.join(own.drop("firm_id", "relative_timepoint"), ["snapshot_id", "url"], "left"), snapshots, config)


def page_rows(chosen: DataFrame, visited: DataFrame, snapshots: DataFrame, config: Config) -> DataFrame:
    """Wide page rows with extraction, checks and duplicate flags, and a placeholder for every snapshot that wasn't selected."""
    both = visited.join(chosen.drop("http_status", "mime_type", "redirect_chain", "fetch_error"), "snapshot_id")
    both = both.withColumn("m", html.extract_metadata("content")).withColumn("t", html.extract_text("content"))
    both = both.withColumn("n", tx.strip_noise(F.col("t.extracted_text"))).withColumn("d", urls.parse_domain(F.col("url")))
    body = F.length("content") > 0
    text = F.when(body, F.coalesce("n.text", F.lit("")))
    both = both.select(
        "*", "m.*", F.col("d.scheme").alias("scheme"), F.col("d.hostname").alias("hostname"), F.col("d.subdomain").alias("subdomain"), F.col("d.registrable_domain").alias("registrable_domain"),
        F.col("d.suffix").alias("suffix"), F.col("d.normalized_url").alias("normalized_url"), F.col("d.path").alias("path"), F.col("d.query").alias("query"),
        text.alias("extracted_text"), F.when(body, F.col("t.extraction_method")).alias("extraction_method"), F.when(body, F.col("t.language")).alias("text_language"),
        F.length(text).alias("character_count"), F.when(body, tx.word_count(text)).alias("word_count"), F.when(body, tx.word_count(text)).alias("token_count"),
        F.when(body, tx.quality_score(text, F.octet_length("content"))).alias("extraction_quality_score"),
        F.when(body & (F.col("t.full_chars") > 0) & (F.length(text) > 0), F.round(1.0 - F.length(text) / F.col("t.full_chars"), 3)).alias("boilerplate_ratio"),
        F.when(body, F.coalesce("n.removed", F.lit(False))).alias("archive_toolbar_removed_flag"), F.col("url").alias("original_archived_url"), F.col("depth").alias("crawl_depth"),
    )
    checked = quality.check_pages(both, F.col("primary_domain"), config.quality)
    flagged = quality.flag_duplicates(checked, ["firm_id", "relative_timepoint", "original_archived_url"], ["rank", "target_year", "_seq"])
    return schemas.conform(flagged, schemas.PAGES).unionByName(schemas.conform(tables.placeholders(snapshots), schemas.PAGES))


def visual_rows(snapshots: DataFrame, probes: DataFrame) -> DataFrame:
    """Homepage styles of selected snapshots. ``probes`` (firm_id, relative_timepoint, headings array<struct<tag, text, font_family, font_size_px, font_weight, color>>, rendered_success, ...)
    holds what a browser measured; the first h1 counts, else the heading in the largest type."""
    h1 = F.get(F.filter("headings", lambda h: h.tag == "h1"), F.lit(0))
    largest = F.aggregate("headings", F.get("headings", F.lit(0)), lambda a, h: F.when(h.font_size_px > a.font_size_px, h).otherwise(a))
    head = F.coalesce(h1, largest)
    sure = F.when(~F.coalesce("rendered_success", F.lit(False)), 0.0).when(h1.isNotNull(), 0.7).otherwise(0.4)
    out = snapshots.where(F.col("snapshot_status") == "selected").join(probes, ["firm_id", "relative_timepoint"], "left").withColumns({
        "h1_text": head["text"], "h1_font_family": head["font_family"], "h1_font_size_px": head["font_size_px"], "h1_font_weight": head["font_weight"], "h1_color": head["color"],
        "visual_extraction_confidence": sure, "original_archived_url": F.col("canonical_original_url"),
        "screenshot_path": F.concat(F.substring(F.sha2(F.concat_ws("|", "firm_id", "relative_timepoint"), 256), 1, 16), F.lit(".png")),
    })
    return schemas.conform(out, schemas.VISUALS)
