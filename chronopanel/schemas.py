"""Column order and types of the tables, and conformance to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns in order, with their types.
FIRMS = (
    "run_id string, firm_id string, rank int, company string, event_type string, event_year int, event_label string, source_confidence string, "
    "wayback_tier string, primary_domain string, website string, event_source_url string, notes string"
)
SNAPSHOTS = (
    "run_id string, firm_id string, rank int, company string, event_type string, event_year int, event_label string, relative_timepoint string, "
    "target_year int, target_date date, observation_is_future boolean, snapshot_status string, capture_source string, requested_url string, "
    "canonical_original_url string, archive_timestamp string, selected_capture_date date, temporal_distance_days int, wayback_replay_url string, "
    "http_status string, mime_type string, digest string, redirect_chain string, selection_reason string, fallback_attempts string, "
    "failure_reason string, event_year_precision_note string, discovered_at timestamp"
)
PAGES = (
    "run_id string, firm_id string, rank int, company string, event_type string, event_year int, event_label string, relative_timepoint string, "
    "target_year int, target_date date, observation_is_future boolean, capture_source string, archive_timestamp string, selected_capture_date date, "
    "temporal_distance_days int, snapshot_status string, wayback_replay_url string, original_archived_url string, requested_url string, "
    "final_url string, redirect_chain string, http_status int, mime_type string, fetch_timestamp timestamp, fetch_error string, content_hash string, "
    "scheme string, hostname string, subdomain string, registrable_domain string, suffix string, normalized_url string, path string, query string, "
    "crawl_depth int, discovered_from_url string, page_priority_reason string, document_title string, meta_description string, meta_keywords string, "
    "html_lang string, canonical_url string, og_title string, og_description string, og_site_name string, h1_text string, h2_text string, "
    "headings_json string, raw_html_path string, extracted_text string, extraction_method string, text_language string, character_count int, "
    "token_count int, word_count int, extraction_quality_score double, boilerplate_ratio double, duplicate_content_flag boolean, soft_404_flag boolean, "
    "archive_toolbar_removed_flag boolean, likely_navigation_only boolean, usable_for_analysis boolean, exclusion_reason string"
)
VISUALS = (
    "run_id string, firm_id string, rank int, company string, relative_timepoint string, target_year int, archive_timestamp string, "
    "wayback_replay_url string, original_archived_url string, rendered_success boolean, viewport_width int, viewport_height int, "
    "screenshot_path string, body_background_color string, header_background_color string, hero_background_color string, h1_text string, "
    "h1_font_family string, h1_font_size_px double, h1_font_weight string, h1_color string, computed_style_source string, css_stylesheet_count int, "
    "missing_asset_count int, visual_extraction_confidence double, visual_extraction_error string, dominant_colors_json string"
)
SUMMARY = (
    "run_id string, firm_id string, rank int, company string, relative_timepoint string, target_year int, snapshot_status string, "
    "pages_attempted bigint, pages_success bigint, pages_usable bigint, pages_excluded bigint, avg_text_chars double, flags string"
)
CAPTURES = "urlkey string, timestamp string, original string, mimetype string, statuscode string, digest string, length string, redirect string"


def columns(ddl: str) -> list[tuple[str, str]]:
    """Names and types of a flat list of columns."""
    return [tuple(c.split(" ", 1)) for c in ddl.split(", ")]  # type: ignore[misc]


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the columns of ``ddl``: missing ones null, others dropped, cast and in order."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(t).alias(n) for n, t in columns(ddl)])
