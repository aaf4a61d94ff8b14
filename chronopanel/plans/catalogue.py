"""Queries over the test tables and their SQL. Every query runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config, Quality, Selection
from ..functions import html, urls
from ..functions import text as tx
from ..operators import asof, captures, grid, quality, tables
from ..session import scratch_path
from ..sources import io
from ..streaming import captures as stream
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = Config(run_date="2026-07-13")
KEY = ["firm_id", "relative_timepoint", "original_archived_url"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _firms(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "firms").distinct()


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").where(F.col("original_archived_url").isNotNull())


def observation_grid(spark: SparkSession, sf: str) -> DataFrame:
    return grid.observations(_firms(spark, sf), CONFIG).select("firm_id", "relative_timepoint", "target_year", "target_date", "observation_is_future")


def _selected(spark: SparkSession, sf: str, tie: str) -> DataFrame:
    seen = grid.observations(_firms(spark, sf), CONFIG)
    out = asof.select_captures(seen, captures.dedupe(_t(spark, sf, "captures")), Selection(tie_break=tie))
    return out.select("firm_id", "relative_timepoint", "snapshot_status", "archive_timestamp", "canonical_original_url", "temporal_distance_days", "selection_reason", "failure_reason")


def snapshot_select(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf, "later")


def snapshot_select_earlier(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf, "earlier")


def snapshot_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf, "later").groupBy("snapshot_status").agg(F.count(F.lit(1)).alias("n"), F.sum("temporal_distance_days").cast("bigint").alias("total_distance"))


def orders_nearest(spark: SparkSession, sf: str) -> DataFrame:
    firms = _t(spark, sf, "customer").select(F.col("c_custkey").alias("firm_id"), (F.lit(1992) + F.col("c_custkey") % 9).cast("int").alias("event_year"))
    seen = grid.observations(firms, Config(run_date="1999-01-01"))
    right = _t(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("firm_id"), F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("timestamp"), F.col("o_orderkey").cast("string").alias("original"), F.lit("text/html").alias("mimetype"), F.lit("200").alias("statuscode"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("redirect"), F.lit(0).alias("seed_ord"), F.col("o_orderkey").alias("row_ord"),
    )
    got = asof.select_captures(seen, right, Selection())
    return got.groupBy("snapshot_status").agg(F.count(F.lit(1)).alias("n"), F.sum("temporal_distance_days").cast("bigint").alias("total_distance"))


def capture_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return captures.dedupe(_t(spark, sf, "captures")).select("firm_id", "timestamp", "original", "seed_ord", "row_ord")


def capture_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return captures.collapse(_t(spark, sf, "captures"), ["firm_id", "urlkey"], ["timestamp", "row_ord"]).select("firm_id", "row_ord", "digest")


def capture_seeds(spark: SparkSession, sf: str) -> DataFrame:
    own = _firms(spark, sf).select("firm_id", F.explode(captures.seeds(F.coalesce("website", F.concat(F.lit("https://www."), "primary_domain")), F.col("primary_domain"), CONFIG.selection.url_variants)).alias("seed"))
    return own.distinct()


def firm_upsert(spark: SparkSession, sf: str) -> DataFrame:
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    fresh = orders.where(F.col("o_custkey") % 10 == 0).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return tables.upsert(orders, fresh, ["o_custkey"])


def firms_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return grid.first_n(_firms(spark, sf), 0, 5).select("firm_id", "rank", "company")


def firm_filter(spark: SparkSession, sf: str) -> DataFrame:
    return tables.of_firms(_t(spark, sf, "snapshots"), ["1", "2", "3"]).groupBy("firm_id", "snapshot_status").agg(F.count(F.lit(1)).alias("n"))


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    own = _pages(spark, sf).select("original_archived_url").distinct()
    return own.select("original_archived_url", urls.parse_domain(F.col("original_archived_url")).alias("d")).select("original_archived_url", "d.*")


def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    own = _pages(spark, sf).select("original_archived_url").distinct()
    return own.select("original_archived_url", urls.normalize(F.col("original_archived_url"), strip_query=True).alias("normalized"), urls.normalize_original(F.col("original_archived_url")).alias("canonical"))


def url_query_filter(spark: SparkSession, sf: str) -> DataFrame:
    own = _pages(spark, sf).select("original_archived_url").distinct()
    return own.select("original_archived_url", urls.normalize(F.col("original_archived_url"), exclude_query_patterns=["utm_", "fbclid", "gclid"]).alias("normalized"))


def url_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("original_archived_url")
    return _pages(spark, sf).select(u).distinct().select(u, urls.is_excluded(u).alias("excluded"))


def branding_score(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("original_archived_url")
    return _pages(spark, sf).select(u).distinct().select(u, urls.branding_score(u, CONFIG.crawl.branding_path_patterns, True).alias("score"))


def replay_url(spark: SparkSession, sf: str) -> DataFrame:
    own = _t(spark, sf, "captures").where(F.col("timestamp").rlike("^[0-9]{14}$")).select("original", "timestamp").distinct()
    built = own.select("original", "timestamp", urls.build_replay_url(F.col("original"), F.col("timestamp")).alias("replay"))
    return built.select("original", "timestamp", "replay", urls.unwrap(F.col("replay")).alias("unwrapped"), urls.is_archive_url(F.col("replay")).alias("is_archive"))


def text_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.length("text").alias("characters"), tx.word_count(F.col("text")).alias("words"), tx.quality_score(F.col("text"), F.octet_length("text") * 3).alias("score"))


def boilerplate_ratio(spark: SparkSession, sf: str) -> DataFrame:
    own = _pages(spark, sf).select("firm_id", "relative_timepoint", "original_archived_url", "meta_description", "extracted_text").distinct()
    return own.select("firm_id", "relative_timepoint", "original_archived_url", tx.boilerplate_ratio(F.col("meta_description"), F.col("extracted_text")).alias("ratio"))


def text_predicates(spark: SparkSession, sf: str) -> DataFrame:
    own = _pages(spark, sf).select("firm_id", "relative_timepoint", "original_archived_url", "document_title", "extracted_text").distinct()
    return own.select("firm_id", "relative_timepoint", "original_archived_url", tx.soft_404(F.col("extracted_text"), F.col("document_title")).alias("soft_404"), tx.menu_only(F.col("extracted_text")).alias("menu_only"))


def noise_lines(spark: SparkSession, sf: str) -> DataFrame:
    own = _pages(spark, sf).where(F.col("extracted_text").isNotNull()).select("firm_id", "relative_timepoint", "original_archived_url", "extracted_text").distinct()
    return own.withColumn("n", tx.strip_noise(F.col("extracted_text"))).select("firm_id", "relative_timepoint", "original_archived_url", F.length("n.text").alias("characters"), F.col("n.removed").alias("removed"))


def content_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return quality.flag_duplicates(docs, ["doc_id"], []).select("doc_id", "content_hash", "duplicate_content_flag")


def page_check(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["firm_id", "relative_timepoint", "original_archived_url", "fetch_error", "http_status", "registrable_domain", "temporal_distance_days", "document_title", "archive_toolbar_removed_flag", "final_url", "extracted_text", "character_count"]
    own = _pages(spark, sf).select(*cols).distinct()
    domain = _firms(spark, sf).groupBy("firm_id").agg(F.min("primary_domain").alias("primary_domain"))
    got = quality.check_pages(own.join(domain, "firm_id"), F.col("primary_domain"), Quality())
    return got.select("firm_id", "relative_timepoint", "original_archived_url", "character_count", "soft_404_flag", "likely_navigation_only", "usable_for_analysis", "exclusion_reason", F.array_join("quality_flags", ",").alias("all_flags"))


def quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    shots = _t(spark, sf, "snapshots").groupBy("firm_id", "relative_timepoint").agg(*[F.min(c).alias(c) for c in ("run_id", "rank", "company", "target_year", "snapshot_status")])
    got = quality.summarize(shots, _pages(spark, sf).drop("fetch_timestamp").distinct())
    return got.select("firm_id", "relative_timepoint", "snapshot_status", "pages_attempted", "pages_success", "pages_usable", "pages_excluded", "avg_text_chars", "flags")


def review_sample(spark: SparkSession, sf: str) -> DataFrame:
    own = _pages(spark, sf).drop("fetch_timestamp").distinct()
    return quality.review_sample(own, 15).select("firm_id", "relative_timepoint", "original_archived_url", "usable_for_analysis", "quality_flags", "extracted_text")


def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    return io.counts(_firms(spark, sf), _t(spark, sf, "snapshots"), _t(spark, sf, "pages")).withColumnsRenamed({"selected_snapshots": "selected", "usable_pages": "usable"})


def placeholder_rows(spark: SparkSession, sf: str) -> DataFrame:
    shots = _t(spark, sf, "snapshots").drop("discovered_at").distinct()
    return schemas.conform(tables.placeholders(shots), schemas.PAGES).select("firm_id", "relative_timepoint", "target_date", "original_archived_url", "usable_for_analysis", "exclusion_reason")


def crawl_bfs(spark: SparkSession, sf: str) -> DataFrame:
    """Traversal of the discovered-from graph of the stored pages: seeds are homepages, links go from the page that discovered a page to it."""
    from ..operators import crawl

    own = _pages(spark, sf).select("firm_id", "relative_timepoint", F.col("original_archived_url").alias("url"), F.col("discovered_from_url").alias("parent"), "registrable_domain", "http_status").distinct()
    own = own.withColumn("snapshot_id", F.concat_ws("|", "firm_id", "relative_timepoint"))
    site = own.where(F.col("parent").isNull()).groupBy("snapshot_id").agg(F.min(F.struct("url", "registrable_domain")).alias("s")).select("snapshot_id", "s.url", F.col("s.registrable_domain").alias("domain"))
    fetched = own.groupBy("snapshot_id", "url").agg(F.min("http_status").alias("status")).withColumn("has_content", F.lit(True))
    links = own.where(F.col("parent").isNotNull()).select("snapshot_id", F.col("parent").alias("url"), F.length("url").alias("pos"), F.col("url").alias("link")).distinct()
    return crawl.traverse(site, fetched, links, CONFIG.crawl)


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    """The capture index by requested address: each stored row under the address of its seed."""
    own = _firms(spark, sf).withColumn("website", F.coalesce("website", F.concat(F.lit("https://www."), "primary_domain")))
    tried = own.select("firm_id", F.posexplode(captures.seeds(F.col("website"), F.col("primary_domain"), CONFIG.selection.url_variants)).alias("seed_ord", "requested_url"))
    return tried.join(_t(spark, sf, "captures"), ["firm_id", "seed_ord"]).drop("firm_id", "seed_ord")


def _websites(spark: SparkSession, sf: str) -> DataFrame:
    return _firms(spark, sf).withColumn("website", F.coalesce("website", F.concat(F.lit("https://www."), "primary_domain")))


def capture_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Captures of every firm over all its addresses, the first row of each kept."""
    return captures.by_variants(_websites(spark, sf), _variants(spark, sf), CONFIG.selection.url_variants).select("firm_id", "seed_ord", "requested_url", "timestamp", "original", "row_ord")


def discover_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot stage from firms and capture index."""
    got = pipeline.discover(_websites(spark, sf), _variants(spark, sf), CONFIG, "2026-07-13T00:00:00")
    return got.select("firm_id", "relative_timepoint", "snapshot_status", "archive_timestamp", "temporal_distance_days", "capture_source", "requested_url", "fallback_attempts", F.col("event_year_precision_note").isNotNull().alias("noted"))


def future_observations(spark: SparkSession, sf: str) -> DataFrame:
    return io.future_rows(_t(spark, sf, "snapshots").drop("discovered_at").distinct())


def firm_identity(spark: SparkSession, sf: str) -> DataFrame:
    return grid.with_identity(_firms(spark, sf).drop("firm_id", "run_id"), "r1").select("rank", "firm_id", "run_id", "company")


def capture_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Capture columns from rows that are JSON arrays, as the index sends them, with a header row."""
    own = _t(spark, sf, "captures").where(F.col("row_ord").isNotNull())
    sent = own.select("row_ord", F.to_json(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in captures.FIELDS])).alias("value"))
    head = spark.range(1).select(F.lit(-1).alias("row_ord"), F.to_json(F.array(*[F.lit(c) for c in captures.FIELDS])).alias("value"))
    return captures.from_json_rows(sent.unionByName(head))


def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Names under which fetched pages are kept."""
    return _pages(spark, sf).where(F.col("archive_timestamp").isNotNull() & F.col("wayback_replay_url").isNotNull()).select("archive_timestamp", "wayback_replay_url").distinct().withColumn("key", io.cache_key("archive_timestamp", "wayback_replay_url"))


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots written as CSV with ISO dates and read again."""
    path = f"{scratch_path(spark, 'csv')}/snapshots.csv"
    io.write_csv(_t(spark, sf, "snapshots"), path, schemas.SNAPSHOTS)
    return io.read_table(spark, path, schemas.SNAPSHOTS).select("firm_id", "relative_timepoint", "target_date", "observation_is_future", "temporal_distance_days", F.date_format("discovered_at", "yyyy-MM-dd HH:mm:ss").alias("discovered"))


def parquet_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Firms written as Parquet by tier and read again."""
    path = scratch_path(spark, "parquet")
    io.write_parquet(_firms(spark, sf), path, ["wayback_tier"])
    return io.read_table(spark, path, schemas.FIRMS).select("firm_id", "company", "event_year", "wayback_tier")


def link_policy(spark: SparkSession, sf: str) -> DataFrame:
    """For each address: whether a crawl of its own site follows it, whether the page that led to it is on the same site, and its place in the queue."""
    u, d = F.col("original_archived_url"), F.col("discovered_from_url")
    own = _pages(spark, sf).groupBy("original_archived_url").agg(F.min("discovered_from_url").alias("discovered_from_url"), F.min("crawl_depth").alias("depth"))
    order = urls.priority(u, F.col("depth"), d.isNull(), CONFIG.crawl.branding_path_patterns, CONFIG.crawl.prefer_german_paths)
    got = own.select(u, urls.should_follow(u, urls.registrable_domain(u)).alias("follow"), urls.same_registrable_domain(u, d).alias("same_site"), order.alias("o"))
    return got.select("original_archived_url", "follow", "same_site", F.col("o.home").alias("home"), F.col("o.depth").alias("depth"), F.col("o.score").alias("score"), F.col("o.size").alias("size"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def _html(spark: SparkSession, sf: str) -> DataFrame:
    """A page of HTML for every stored page: its title, description, language and heading, a menu, and a block for each line of its text."""
    part = lambda c, before, after: F.when(F.col(c).isNotNull(), F.concat(F.lit(before), _escaped(F.col(c)), F.lit(after))).otherwise("")
    blocks = F.array_join(F.transform(F.split(F.coalesce("extracted_text", F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>"))), "\n")
    body = F.concat(
        F.lit("<!doctype html><html"), part("html_lang", ' lang="', '"'), F.lit(">\n<head>"), part("document_title", "<title>", "</title>"), part("meta_description", '<meta name="description" content="', '">'),
        F.lit('<style>p {x: y}</style></head><body><nav><a href="/kontakt">Kontakt</a><a href="#top"> </a><a href=""></a></nav>'), part("h1_text", "<h1>", "</h1>"), blocks,
        F.lit('<a href="/web/20150301000000/http://www.andere.example/a%20b"></a><script>var x = "<p>no</p>";</script></body></html>'),
    )
    own = _pages(spark, sf).select(*KEY, "document_title", "meta_description", "html_lang", "h1_text", "extracted_text").distinct()
    return own.select(*KEY, F.encode(body, "utf-8").alias("content"), F.col("original_archived_url").alias("url"), body.alias("html"))


def html_metadata(spark: SparkSession, sf: str) -> DataFrame:
    got = _html(spark, sf).withColumn("m", html.extract_metadata("content"))
    return got.select(*KEY, "m.document_title", "m.meta_description", "m.html_lang", "m.h1_text", "m.og_title", F.size("m.headings").alias("headings"))


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    got = _html(spark, sf).withColumn("t", html.extract_text("content"))
    full = F.col("t.full_chars")
    return got.select(*KEY, "t.extraction_method", F.sha2("t.extracted_text", 256).alias("text_hash"), full.alias("full_chars"), F.when((full > 0) & (F.length("t.extracted_text") > 0), F.round(1.0 - F.length("t.extracted_text") / full, 3)).alias("ratio"))


def html_links(spark: SparkSession, sf: str) -> DataFrame:
    return html.links(_html(spark, sf), KEY)


def html_by_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """First title and link targets by regular expressions alone."""
    return _html(spark, sf).select(*KEY, html.first_tag(F.col("html"), "title").alias("title"), F.array_join(html.hrefs(F.col("html")), " ").alias("targets"))


def homepage_visuals(spark: SparkSession, sf: str) -> DataFrame:
    """Headings of homepages as a browser would measure them, made up from each snapshot's rank: the first h1, else the largest."""
    shots = _t(spark, sf, "snapshots").groupBy("firm_id", "relative_timepoint").agg(*[F.min(c).alias(c) for c in ("run_id", "rank", "company", "target_year", "snapshot_status", "canonical_original_url")])
    h = lambda tag, text, size: F.struct(tag.alias("tag"), F.lit(text).alias("text"), F.lit("Arial").alias("font_family"), size.cast("double").alias("font_size_px"), F.lit("400").alias("font_weight"), F.lit("#000").alias("color"))
    r = F.col("rank")
    probes = shots.select("firm_id", "relative_timepoint", F.array(h(F.lit("h2"), "a", r % 7 + 10), h(F.when(r % 2 == 0, "h1").otherwise("h2"), "b", r % 5 + 10), h(F.lit("h3"), "c", r % 3 + 12)).alias("headings"), (r % 11 != 0).alias("rendered_success"))
    return pipeline.visual_rows(shots, probes).select("firm_id", "relative_timepoint", "h1_text", "h1_font_size_px", "visual_extraction_confidence", "screenshot_path")


def stream_captures(spark: SparkSession, sf: str) -> DataFrame:
    """The capture index read as a stream, each capture once, written by a streaming query and read again."""
    source = spark.readStream.schema(_t(spark, sf, "captures").schema).parquet(f"{sf}/captures.parque[t]")
    own = stream.distinct_captures(source.withColumn("arrived_at", F.lit("2026-01-01").cast("timestamp"))).select("firm_id", "timestamp", "original")
    path = scratch_path(spark, "stream")
    own.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("firm_id string, timestamp string, original string").parquet(f"{path}/rows")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        snapshot_status_counts, observation_grid, snapshot_select, snapshot_select_earlier, orders_nearest, capture_dedupe, capture_collapse, capture_seeds, firm_upsert, firms_top_n, firm_filter,
        url_parts, url_normalize, url_query_filter, url_exclusion, branding_score, replay_url, text_counts, boilerplate_ratio, text_predicates, noise_lines, content_dedupe, page_check, quality_summary, review_sample,
        manifest_counts, placeholder_rows, crawl_bfs, capture_variants, discover_snapshots, future_observations, firm_identity, capture_rows, cache_keys, csv_round_trip, parquet_round_trip,
        link_policy, html_metadata, html_text, html_links, html_by_pattern, homepage_visuals, stream_captures,
    )
}
