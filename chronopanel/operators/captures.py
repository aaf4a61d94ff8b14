"""Capture-index rows: parsing, union over address variants, first-wins dedupe, collapse of unchanged neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..schemas import CAPTURES, columns

FIELDS = [n for n, _ in columns(CAPTURES)]


def from_json_rows(rows: DataFrame, column: str = "value") -> DataFrame:
    """Capture columns from rows that are JSON arrays of strings. Short rows are padded with ``""``; a row equal to the field list is a header and dropped; unparsable rows are dropped."""
    cells = F.from_json(F.col(column), "array<string>")
    out = rows.withColumn("_c", cells).where(F.col("_c").isNotNull() & (F.array_join("_c", ",") != ",".join(FIELDS)))
    rest = [c for c in rows.columns if c != column]
    return out.select(*rest, *[F.coalesce(F.get("_c", F.lit(i)), F.lit("")).alias(f) for i, f in enumerate(FIELDS)])


def seeds(website: Column, domain: Column, templates: list[str]) -> Column:
    """Sorted distinct addresses under which a site's captures are looked up."""
    own = F.concat(F.regexp_replace(website, "/+$", ""), F.lit("/"))
    fixed = [F.concat(F.lit("https://www."), domain, F.lit("/")), F.concat(F.lit("https://"), domain, F.lit("/"))]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(own, *fixed, *[urls.fill_template(F.lit(t), domain) for t in templates]))))


def attempts_json(tried: Column) -> Column:
    """A sorted list of tried addresses as JSON."""
    return F.to_json(F.array_sort(F.array_distinct(tried)))


def by_variants(firms: DataFrame, index: DataFrame, templates: list[str]) -> DataFrame:
    """Captures of every firm over all its addresses: exploded seeds joined with ``index`` (requested_url, row_ord, capture columns), first row of each capture kept.

    A variant without captures contributes nothing.
    """
    tried = firms.select("firm_id", F.posexplode(seeds(F.col("website"), F.col("primary_domain"), templates)).alias("seed_ord", "requested_url"))
    return dedupe(tried.join(index, "requested_url"))


def dedupe(captures: DataFrame) -> DataFrame:
    """First row of every (firm_id, timestamp, original) by (seed_ord, row_ord). One aggregation with map-side combination, so repeated rows don't travel."""
    rest = [c for c in captures.columns if c not in ("firm_id", "timestamp", "original")]
    best = captures.groupBy("firm_id", "timestamp", "original").agg(F.min_by(F.struct(*rest), F.struct("seed_ord", "row_ord")).alias("_r"))
    return best.select("firm_id", "timestamp", "original", "_r.*").select(*captures.columns)


def collapse(captures: DataFrame, key: list[str], order: list[str], value: str = "digest") -> DataFrame:
    """Rows whose ``value`` differs from the row before them in ``order``; null differs from any value but null."""
    w = Window.partitionBy(*key).orderBy(*order)
    flagged = captures.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    return flagged.where((F.col("_n") == 1) | ~F.col("_p").eqNullSafe(F.col(value))).drop("_p", "_n")
