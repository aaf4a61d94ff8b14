"""Command line: ``python -m chronopanel COMMAND [--config FILE] ...``. Stages read the tables of earlier ones from the output folder and run them if they are missing."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schemas
from .config import Config
from .operators import quality, tables
from .plans import pipeline
from .session import discard
from .sources import io

COMMANDS = ("prepare", "discover-snapshots", "crawl", "extract", "visuals", "report", "run")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="chronopanel")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--config")
    p.add_argument("--input", help="firm list (CSV)")
    p.add_argument("--index", help="capture index (Parquet: requested_url, row_ord, capture columns)")
    p.add_argument("--fetched", help="fetched pages (Parquet)")
    p.add_argument("--probes", help="measured homepage styles (Parquet)")
    p.add_argument("--top-n", type=int)
    p.add_argument("--firm-id", action="append")
    a = p.parse_args(args)
    config = (Config.from_yaml(a.config) if a.config else Config()).resolve(Path.cwd())
    spark = SparkSession.builder.appName("chronopanel").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out, now = config.output_dir, datetime.now(UTC).isoformat()
    at = lambda name: f"{out}/{name}"

    def firms():
        if a.command in ("prepare", "run") or not Path(at("firms")).exists():
            io.write_parquet(pipeline.prepare(io.read_longlist(spark, a.input or config.input_csv), config, a.top_n), at("firms"))
        return io.read_table(spark, at("firms"), schemas.FIRMS)

    def snapshots():
        own = firms()
        if a.command in ("discover-snapshots", "run") or not Path(at("snapshots")).exists():
            io.write_parquet(pipeline.discover(own, spark.read.parquet(a.index), config, now, a.firm_id), at("snapshots"))
        return io.read_table(spark, at("snapshots"), schemas.SNAPSHOTS)

    def pages():
        chosen, own = snapshots(), io.read_table(spark, at("firms"), schemas.FIRMS)
        if a.command in ("crawl", "extract", "run"):
            fresh = pipeline.crawl_and_extract(tables.of_firms(chosen, a.firm_id), own, spark.read.parquet(a.fetched), config)
            if a.firm_id and Path(at("pages")).exists():
                fresh = tables.of_firms(fresh, a.firm_id).unionByName(io.read_table(spark, at("pages"), schemas.PAGES).where(~F.col("firm_id").isin(a.firm_id)))
            io.write_parquet(fresh, at("pages.new"))
            io.write_parquet(spark.read.parquet(at("pages.new")), at("pages"))
        return io.read_table(spark, at("pages"), schemas.PAGES) if Path(at("pages")).exists() else spark.createDataFrame([], schemas.PAGES)

    if a.command == "prepare":
        firms()
    elif a.command == "discover-snapshots":
        snapshots()
    elif a.command in ("crawl", "extract"):
        pages()
    if a.command in ("visuals", "run") and a.probes:
        io.write_parquet(pipeline.visual_rows(snapshots(), spark.read.parquet(a.probes)), at("homepage_visuals"))
    if a.command in ("report", "run"):
        got, chosen = pages(), io.read_table(spark, at("snapshots"), schemas.SNAPSHOTS)
        summary = quality.summarize(chosen, got)
        io.write_csv(summary, at("quality_summary"), schemas.SUMMARY)
        io.write_parquet(quality.review_sample(got, config.quality.manual_validation_sample_size), at("manual_validation_sample"))
        io.write_manifest(io.manifest(config, io.read_table(spark, at("firms"), schemas.FIRMS), chosen, got, now), at("run_manifest.json"))
        Path(at("coverage_report.md")).write_text(io.report(chosen, summary, config.run_id, now), encoding="utf-8")
    discard(spark)


if __name__ == "__main__":
    main()
