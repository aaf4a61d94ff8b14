"""Queries of this package over the test tables, with production parameters and over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bodies, encoding, language, leak, lines, nearest, pack, pages, quality, residue, spans

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.found(_t(spark, sf, "pages"))


def p1_restored(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.restored(_t(spark, sf, "pages"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.found(pages.prepared(_t(spark, sf, "pages"), marks=True, or_title=True))


def p2_residue(spark: SparkSession, sf: str) -> DataFrame:
    return residue.pieces(pages.prepared(_t(spark, sf, "pages"), marks=True, or_title=True))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return bodies.found(pages.prepared(_t(spark, sf, "pages")))


def p3_bodies(spark: SparkSession, sf: str) -> DataFrame:
    table = _t(spark, sf, "pages")
    return bodies.bodies(table, pages.prepared(table))


def _labelled(spark: SparkSession, sf: str, **options: bool) -> DataFrame:
    table, words = _t(spark, sf, "pages"), _t(spark, sf, "common_words")
    return pages.prepared(table, language.profiles(table, words), words if not options.get("languages") else None, marks=True, **options)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.found(_t(spark, sf, "snapshots"), _t(spark, sf, "captures"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.found(p5_statistics(spark, sf))


def p5_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.assessed(_labelled(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.found(_labelled(spark, sf, languages=True))


def p6_segments(spark: SparkSession, sf: str) -> DataFrame:
    return language.segments(_labelled(spark, sf, languages=True))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return lines.found(_t(spark, sf, "pages"))


def p7_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return lines.cleaned(_t(spark, sf, "pages"))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack.packed(_t(spark, sf, "documents"), _t(spark, sf, "pack_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leak.found(_t(spark, sf, "documents"), _t(spark, sf, "evaluation_items"))


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return leak.report(_t(spark, sf, "documents"), _t(spark, sf, "evaluation_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.found(_t(spark, sf, "documents"))


def p10_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return spans.coverage(_t(spark, sf, "documents"))


def p10_links(spark: SparkSession, sf: str) -> DataFrame:
    return spans.links(_t(spark, sf, "documents"))


def p10_classes(spark: SparkSession, sf: str) -> DataFrame:
    return spans.classes(_t(spark, sf, "documents")).select("doc_id", "class_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_restored, p2_found, p2_residue, p3_found, p3_bodies, p4_found, p5_found, p5_statistics, p6_found, p6_segments, p7_found, p7_cleaned, p8_containers, p9_found, p9_report, p10_found, p10_coverage, p10_links, p10_classes,
    )
}
#: Where SQL can say the same on whole tables in reasonable time.
SQL = {
    "p4_found": """
with o as (select distinct firm_id, relative_timepoint, target_date from snapshots where not observation_is_future),
c as (select distinct firm_id, timestamp as ts, try_strptime(substr(timestamp, 1, 8), '%Y%m%d')::date as d from captures
      where statuscode = '200' and mimetype = 'text/html' and regexp_full_match(timestamp, '[0-9]{14}') and try_strptime(timestamp, '%Y%m%d%H%M%S') is not null)
select o.firm_id, relative_timepoint, ts as archive_timestamp from o join c on o.firm_id = c.firm_id and abs(d - target_date) <= 548
qualify row_number() over (partition by o.firm_id, relative_timepoint order by abs(d - target_date), ts desc) = 1""",
    "p7_found": """
with l as (select distinct registrable_domain, firm_id, relative_timepoint, original_archived_url,
             trim(regexp_replace(translate(x, chr(9) || chr(160), '  '), ' +', ' ', 'g'), ' ') as line_text
           from (select *, unnest(string_split(extracted_text, chr(10))) as x from pages where original_archived_url is not null and registrable_domain is not null))
select registrable_domain, line_text from l where line_text <> '' group by all having count(*) >= 8""",
    "p7_cleaned": """
with p as (select distinct firm_id, relative_timepoint, original_archived_url, registrable_domain, extracted_text from pages
           where original_archived_url is not null and trim(translate(extracted_text, chr(10) || chr(9) || chr(160), '')) <> ''),
t as (select *, string_split(extracted_text, chr(10)) as l, list_transform(string_split(extracted_text, chr(10)), lambda x: trim(regexp_replace(translate(x, chr(9) || chr(160), '  '), ' +', ' ', 'g'), ' ')) as k from p),
e as (select distinct registrable_domain, firm_id, relative_timepoint, original_archived_url, unnest(k) as x from t where registrable_domain is not null),
f as (select registrable_domain, list(x) as often from (select registrable_domain, x from e where x <> '' group by all having count(*) >= 8) group by 1),
c as (select t.*, list_filter(range(1, len(l) + 1), lambda i: not coalesce(list_contains(often, k[i]), false)) as keep from t left join f using (registrable_domain))
select firm_id, relative_timepoint, original_archived_url, array_to_string(list_transform(keep, lambda i: l[i]), chr(10)) as text, cast(len(l) - len(keep) as integer) as removed_lines from c""",
    "p10_classes": "select doc_id, min(doc_id) over (partition by text) as class_id from documents where doc_id is not null and text is not null",
    "p9_found": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(nfc_normalize(text)), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from documents),
e as (select eval_id, list_filter(regexp_split_to_array(lower(nfc_normalize(passage)), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from evaluation_items),
dw as (select doc_id, unnest([array_to_string(w[i:i + 12], ' ') for i in range(1, len(w) - 11)]) as k from d where len(w) >= 13),
ew as (select eval_id, unnest([array_to_string(w[i:i + 12], ' ') for i in range(1, len(w) - 11)]) as k from e where len(w) >= 13)
select distinct eval_id, doc_id from dw join ew using (k)""",
}
