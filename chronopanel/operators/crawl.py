"""Bounded breadth-first traversal of sites whose pages and links are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Crawl
from ..functions import urls
from ..session import materialise


def traverse(seeds: DataFrame, fetched: DataFrame, links: DataFrame, config: Crawl) -> DataFrame:
    """``snapshot_id, url, depth, discovered_from_url, page_priority_reason, fetch_seq`` of the pages that a crawl visits, in its order.

    ``seeds``: snapshot_id, url, domain (one row each). ``fetched``: snapshot_id, url, status, has_content. ``links``: snapshot_id, url, pos,
    link. All addresses are normalised, so none is an archive address. The first page to discover an address claims it; a page's links are ordered by score, length of path and place; a
    fetched page counts against the budget even if it failed, and only pages with status 200 and content are followed. Levels are unrolled
    (depth is bounded) and each is written out, so the lineage stays short.
    """
    budget = 1 if config.homepage_only else config.max_pages_per_snapshot
    ok = seeds.where(urls.should_follow(F.col("url"), F.col("domain"), config.extract_pdf, wrapped=False))
    level = ok.select("snapshot_id", "domain", "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("discovered_from_url"), F.lit("homepage").alias("page_priority_reason"), F.lit(1).cast("long").alias("fetch_seq"))
    level = materialise(level, "crawl-0")
    claimed = level.select("snapshot_id", "url")
    done = level
    good = fetched.where((F.col("status") == 200) & F.col("has_content")).select("snapshot_id", "url")
    for depth in range(1, 1 if config.homepage_only else config.max_depth + 1):
        open_ = level.where(F.col("fetch_seq") <= budget).join(good, ["snapshot_id", "url"], "left_semi")
        out = open_.select("snapshot_id", "domain", F.col("url").alias("parent"), F.col("fetch_seq").alias("parent_seq")).join(links.withColumnRenamed("url", "parent"), ["snapshot_id", "parent"])
        out = out.where(urls.should_follow(F.col("link"), F.col("domain"), config.extract_pdf, wrapped=False))
        first = out.groupBy("snapshot_id", "domain", F.col("link").alias("url")).agg(F.min(F.struct("parent_seq", "pos", "parent")).alias("f"))
        new = first.join(claimed, ["snapshot_id", "url"], "left_anti")
        score = urls.branding_score(F.col("url"), config.branding_path_patterns, config.prefer_german_paths, wrapped=False)
        ranked = new.select("snapshot_id", "domain", "url", F.lit(depth).alias("depth"), F.col("f.parent").alias("discovered_from_url"), F.concat(F.lit("branding_score:"), score.cast("string")).alias("page_priority_reason"), F.col("f.parent_seq").alias("p"), (-score).alias("s"), F.length(urls.raw_path(F.col("url"))).alias("n"), F.col("f.pos").alias("o"))
        used = done.groupBy("snapshot_id").agg(F.max("fetch_seq").alias("used"))
        order = Window.partitionBy("snapshot_id").orderBy("p", "s", "n", "o", "url")
        numbered = ranked.withColumn("r", F.row_number().over(order)).join(used, "snapshot_id").withColumn("fetch_seq", F.col("used") + F.col("r"))
        level = materialise(numbered.select(*done.columns), f"crawl-{depth}")
        claimed = claimed.unionByName(level.select("snapshot_id", "url"))
        done = done.unionByName(level)
    return done.where(F.col("fetch_seq") <= budget).select("snapshot_id", "url", "depth", "discovered_from_url", "page_priority_reason", "fetch_seq")
