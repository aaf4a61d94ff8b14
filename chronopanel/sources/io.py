"""Readers and writers. Tables have explicit schemas; nothing is inferred."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.captures import from_json_rows
from ..config import Config

LONGLIST = (
    "rank int, company string, event_type string, event_year int, event_label string, source_confidence string, wayback_tier string, "
    "screening_recommendation string, pre_html_pages int, post_html_pages int, primary_domain string, website string, event_source_url string, notes string"
)


def read_longlist(spark: SparkSession, path: str) -> DataFrame:
    """The firm list: UTF-8 CSV with header, quoted fields and any line ends."""
    return spark.read.schema(LONGLIST).option("header", True).option("multiLine", True).csv(path).where(F.col("rank").isNotNull())


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A stored table (Parquet, or CSV by its ending) with the given columns and types."""
    if path.rstrip("/").endswith(".csv"):
        return schemas.conform(spark.read.schema(ddl).option("header", True).option("multiLine", True).option("escape", '"').csv(path), ddl)
    return schemas.conform(spark.read.parquet(path), ddl)


def read_capture_json(spark: SparkSession, path: str) -> DataFrame:
    """Capture rows from files that are each one JSON array of arrays; header rows are dropped."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("r")).select(F.to_json("r").alias("value"))
    return from_json_rows(rows)


def read_page_files(spark: SparkSession, path: str, max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """Stored page bodies, one file each: ``path, content`` (cut at ``max_bytes``), ``content_hash``."""
    files = spark.read.format("binaryFile").load(path)
    body = F.substring("content", 1, max_bytes)
    return files.select("path", body.alias("content"), F.sha2(body, 256).alias("content_hash"))


def cache_key(*parts: str) -> Column:
    """SHA-256 over columns joined by ``|``, as stored pages are named."""
    return F.sha2(F.concat_ws("|", *[F.col(p) for p in parts]), 256)


def fetched(responses: DataFrame, max_bytes: int) -> DataFrame:
    """Responses as fetched pages: body cut at ``max_bytes``, its hash, media type without parameters. Failed ones keep their error and no body."""
    body = F.substring("body", 1, max_bytes)
    return responses.withColumns({"content": body, "content_hash": F.sha2(body, 256), "mime_type": F.trim(F.split_part("content_type", F.lit(";"), F.lit(1)))})


def write_csv(df: DataFrame, path: str, ddl: str) -> None:
    """A table as CSV with fixed columns."""
    schemas.conform(df, ddl).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def counts(firms: DataFrame, snapshots: DataFrame, pages: DataFrame) -> DataFrame:
    """One row with the numbers of firms, snapshots, selected snapshots, pages and usable pages."""
    return (
        firms.agg(F.count(F.lit(1)).alias("firms"))
        .crossJoin(snapshots.agg(F.count(F.lit(1)).alias("snapshots"), F.count_if(F.col("snapshot_status") == "selected").alias("selected_snapshots")))
        .crossJoin(pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.coalesce("usable_for_analysis", F.lit(False))).alias("usable_pages")))
    )


def manifest(config: Config, firms: DataFrame, snapshots: DataFrame, pages: DataFrame, created_at: str, commit: str | None = None) -> dict:
    """Settings and counts of a run; one row comes to the driver."""
    return {"run_id": config.run_id, "created_at": created_at, "git_commit": commit, "config": dataclasses.asdict(config), "counts": counts(firms, snapshots, pages).first().asDict()}


def write_manifest(values: dict, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(values, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def future_rows(snapshots: DataFrame) -> DataFrame:
    """Observations whose target lies after the run's date."""
    return snapshots.where(F.col("snapshot_status") == "future_unavailable").select("company", "relative_timepoint", "target_year")


def report(snapshots: DataFrame, summary: DataFrame, run_id: str, created_at: str) -> str:
    """Coverage report in Markdown. It lists every snapshot, so it is meant for runs of the size a person reads."""
    rows = snapshots.orderBy("rank", "target_year").select("company", "relative_timepoint", "target_year", "snapshot_status", "temporal_distance_days").collect()
    show = lambda x: "" if x is None else str(x)
    out = ["# Coverage report", "", f"Run `{run_id}`, {created_at}", "", "## Snapshots", "", "| Company | Timepoint | Target year | Status | Distance (days) |", "|-|-|-|-|-|"]
    out += [f"| {' | '.join(show(x) for x in r)} |" for r in rows]
    pages = summary.orderBy("rank", "target_year").select("company", "relative_timepoint", "pages_attempted", "pages_usable", "avg_text_chars").collect()
    out += ["", "## Pages", ""]
    out += ["| Company | Timepoint | Attempted | Usable | Mean characters |", "|-|-|-|-|-|", *[f"| {' | '.join(show(x) for x in r)} |" for r in pages]] if pages else ["No pages extracted."]
    future = [r for r in rows if r["snapshot_status"] == "future_unavailable"]
    if future:
        out += ["", "## Observations in the future", "", *[f"- {r['company']} / {r['relative_timepoint']} (target {r['target_year']})" for r in future]]
    return "\n".join(out) + "\n"
