"""SQL that gives the results of :mod:`catalogue` on the same tables."""

from __future__ import annotations

from ..config import Config
from ..functions import urls

_C = Config()
_GRID = """
  select f.firm_id, t.tp as relative_timepoint, cast(f.event_year + t.o as integer) as target_year, make_date(f.event_year + t.o, 7, 1) as target_date,
         make_date(f.event_year + t.o, 7, 1) > date '{today}' as observation_is_future
  from {firms} f cross join (values ('pre_pre_event', -4), ('pre_event', -2), ('event', 0), ('post_event', 2), ('post_post_event', 4)) t(tp, o)"""
_FIRMS = "(select distinct * from firms)"
_SAFE = "[A-Za-z0-9_.~:/?=&%+#-]"


def _select(firms: str, captures: str, today: str, tie: str) -> str:
    return f"""
with grid as ({_GRID.format(firms=firms, today=today)}),
cap as (select *, try_strptime(substr(timestamp, 1, 8), '%Y%m%d')::date as d from ({captures}) where statuscode = '200' and mimetype = 'text/html'),
j as (select g.*, c.timestamp as ts, c.original, c.d, c.row_ord, c.seed_ord, c.statuscode, abs(c.d - g.target_date) as dist
      from grid g left join cap c on c.firm_id = g.firm_id and not g.observation_is_future),
r as (select *, row_number() over (partition by firm_id, relative_timepoint order by case when dist <= 548 then 0 else 1 end, dist, d {tie}, seed_ord, row_ord) as rn,
        count(statuscode) over (partition by firm_id, relative_timepoint) as n, count(case when dist <= 548 then 1 end) over (partition by firm_id, relative_timepoint) as near from j),
s as (select *, case when observation_is_future then 'future_unavailable' when n = 0 then 'not_found' when near = 0 then 'beyond_tolerance' else 'selected' end as snapshot_status from r where rn = 1)
select firm_id, relative_timepoint, snapshot_status, case when near > 0 then ts end as archive_timestamp, case when near > 0 then original end as canonical_original_url,
  case when near > 0 then cast(dist as integer) end as temporal_distance_days,
  case when snapshot_status = 'future_unavailable' then 'future_unavailable' when near = 0 then null when dist = 0 then 'exact_date_match' when d < target_date then 'closest_within_548d_earlier' else 'closest_within_548d_later' end as selection_reason,
  case when snapshot_status = 'not_found' then 'no_matching_captures' when snapshot_status = 'beyond_tolerance' then 'nearest_capture_exceeds_548_days' end as failure_reason
from s"""


_DEDUPED = "select * from captures qualify row_number() over (partition by firm_id, timestamp, original order by seed_ord, row_ord) = 1"
_U = "(select distinct original_archived_url from pages where original_archived_url is not null)"
_P = "pages where original_archived_url is not null"
_RX = {n: f"regexp_extract(original_archived_url, '{urls.SPLIT}', {n})" for n in range(1, 6)}
_HOST = f"lower({_RX[2]})"
_PATH = f"case when {_RX[3]} = '' then '/' else {_RX[3]} end"
_CLEAN = f"case when {_RX[3]} = '' then '/' when {_RX[3]} <> '/' then regexp_replace({_RX[3]}, '/+$', '') else '/' end"
_SCORE = " + ".join(
    ["greatest(0, 30 - length(p))"]
    + [f"case when contains(p, '{x}') then {110 - i} else 0 end" for i, x in enumerate(_C.crawl.branding_path_patterns["de"])]
    + [f"case when contains(p, '{x}') then {50 - i} else 0 end" for i, x in enumerate(_C.crawl.branding_path_patterns["en"])]
)
_WORDS = r"list_filter(regexp_split_to_array(coalesce({t}, ''), '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda w: w <> '')"
_MENU = "'home', 'kontakt', 'contact', 'impressum', 'datenschutz', 'privacy', 'login'"
_SOFT = "regexp_matches(lower(coalesce({ti}, '') || ' ' || coalesce({t}, '')), '404|not found|seite nicht gefunden|page not found|error 404') and length(coalesce({t}, '')) < 300"
_NAV = "(len({w}) < 30 or (len(list_filter(({w})[1:40], lambda w: trim(lower(w), '.,;:') in (" + _MENU + "))) >= 6 and len({w}) < 120))"
_KEY = "firm_id, relative_timepoint, original_archived_url"


def _text(template: str) -> str:
    return template.format(t="extracted_text", ti="document_title", w=_WORDS.format(t="extracted_text"))


_ORDERS = """select o_custkey as firm_id, strftime(o_orderdate, '%Y%m%d%H%M%S') as timestamp, cast(o_orderkey as varchar) as original, 'text/html' as mimetype, '200' as statuscode,
  0 as seed_ord, o_orderkey as row_ord from orders where o_orderstatus = 'F'"""
_CUSTOMERS = "(select c_custkey as firm_id, cast(1992 + c_custkey % 9 as integer) as event_year from customer)"
_COUNTS = "select snapshot_status, count(*) as n, cast(sum(temporal_distance_days) as bigint) as total_distance from ({q}) group by 1"

_FOLLOW = f"""not (regexp_matches(lower({{u3}}), '{urls.EXCLUDED_PATH}') or lower({{u1}}) in ('mailto', 'tel', 'javascript')
  or (contains(lower({{u3}}), '.') and list_last(string_split(lower({{u3}}), '.')) in ({", ".join(f"'{e}'" for e in urls.EXTENSIONS)})))"""
_SITE = "array_to_string(string_split(regexp_replace(lower({h}), ':\\d*$', ''), '.')[-2:], '.')"


def _part(column: str, n: int) -> str:
    return f"regexp_extract({column}, '{urls.SPLIT}', {n})"


def _follow(column: str, domain: str) -> str:
    return f"({_FOLLOW.format(u1=_part(column, 1), u3=_part(column, 3))} and {_SITE.format(h=_part(column, 2))} = {domain})"


def _level(depth: int) -> str:
    """Pages that are new at a depth, numbered in the order in which a crawl fetches them."""
    seen = " union all ".join(f"select snap, url from l{d}" for d in range(depth))
    return f"""
f{depth} as (select l.snap, l.domain, k.link as url, min((l.seq, k.pos, l.url)) as f from l{depth - 1} l join good g on g.snap = l.snap and g.url = l.url and l.seq <= {_C.crawl.max_pages_per_snapshot}
  join links k on k.snap = l.snap and k.parent = l.url where {_follow("k.link", "l.domain")} group by all),
s{depth} as (select *, lower({_part("url", 3)}) as p from f{depth} where (snap, url) not in ({seen})),
r{depth} as (select *, cast({_SCORE} as integer) as score from s{depth}),
l{depth} as (select snap, domain, url, {depth} as depth, f[3] as discovered_from_url, 'branding_score:' || score as reason,
  (select max(seq) from l{depth - 1} b where b.snap = r{depth}.snap) + row_number() over (partition by snap order by f[1], -score, length({_part("url", 3)}), f[2], url) as seq from r{depth})"""


_CRAWL = f"""
with own as (select distinct firm_id || '|' || relative_timepoint as snap, original_archived_url as url, discovered_from_url as parent, registrable_domain as domain, http_status from {_P}),
site as (select snap, (min((url, domain)))[1] as url, (min((url, domain)))[2] as domain from own where parent is null group by 1),
good as (select snap, url from own group by all having min(http_status) = 200),
links as (select distinct snap, parent, length(url) as pos, url as link from own where parent is not null),
l0 as (select snap, domain, url, 0 as depth, cast(null as varchar) as discovered_from_url, 'homepage' as reason, cast(1 as bigint) as seq from site where {_follow("url", "domain")}),
{_level(1)},
{_level(2)}
select snap as snapshot_id, url, depth, discovered_from_url, reason as page_priority_reason, seq as fetch_seq from (select * from l0 union all select * from l1 union all select * from l2) where seq <= {_C.crawl.max_pages_per_snapshot}"""
_TRIED = f"""(select *, list_sort(list_distinct([regexp_replace(w, '/+$', '') || '/', 'https://www.' || d || '/', 'https://' || d || '/', 'http://www.' || d || '/', 'http://' || d || '/'])) as tried
  from (select *, primary_domain as d, coalesce(website, 'https://www.' || primary_domain) as w from {_FIRMS}))"""
_INDEX = f"""(select t.tried[c.seed_ord + 1] as requested_url, c.* exclude (firm_id, seed_ord) from {_TRIED} t join captures c on c.firm_id = t.firm_id and c.seed_ord < len(t.tried))"""
_VARIANTS = f"""(select * from (select t.firm_id, s.i - 1 as seed_ord, x.* from {_TRIED} t, unnest(range(1, len(t.tried) + 1)) s(i), {_INDEX} x where x.requested_url = t.tried[s.i])
  qualify row_number() over (partition by firm_id, timestamp, original order by seed_ord, row_ord) = 1)"""
_WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '^{_WHITE}+', ''), '{_WHITE}+$', '')"


_HTML_PAGES = f"(select distinct {_KEY}, document_title, meta_description, html_lang, h1_text, extracted_text from {_P})"
_HEADING = f"nullif({_strip('h1_text')}, '')"

SQL: dict[str, str] = {
    "observation_grid": _GRID.format(firms=_FIRMS, today="2026-07-13"),
    "snapshot_select": _select(_FIRMS, _DEDUPED, "2026-07-13", "desc"),
    "snapshot_select_earlier": _select(_FIRMS, _DEDUPED, "2026-07-13", "asc"),
    "snapshot_status_counts": _COUNTS.format(q=_select(_FIRMS, _DEDUPED, "2026-07-13", "desc")),
    "orders_nearest": _COUNTS.format(q=_select(_CUSTOMERS, _ORDERS, "1999-01-01", "desc")),
    "capture_dedupe": f"select firm_id, timestamp, original, seed_ord, row_ord from ({_DEDUPED})",
    "capture_collapse": """
select firm_id, row_ord, digest from (select *, lag(digest) over w as p, row_number() over w as n from captures window w as (partition by firm_id, urlkey order by timestamp nulls first, row_ord))
where n = 1 or p is distinct from digest""",
    "capture_seeds": f"""
with f as (select firm_id, primary_domain as d, coalesce(website, 'https://www.' || primary_domain) as w from {_FIRMS})
select distinct firm_id, unnest([regexp_replace(w, '/+$', '') || '/', 'https://www.' || d || '/', 'https://' || d || '/', 'http://www.' || d || '/', 'http://' || d || '/']) as seed from f""",
    "firm_upsert": """
with fresh as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2 as o_totalprice from orders where o_custkey % 10 = 0)
select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_custkey not in (select o_custkey from fresh) union all select * from fresh""",
    "firms_top_n": f"select firm_id, rank, company from {_FIRMS} order by rank, firm_id limit 5",
    "firm_filter": "select firm_id, snapshot_status, count(*) as n from snapshots where firm_id in ('1', '2', '3') group by all",
    "url_parts": f"""
select original_archived_url, case when {_RX[1]} = '' then 'https' else lower({_RX[1]}) end as scheme, {_HOST} as hostname,
  case when len(l) > 2 then array_to_string(l[:-3], '.') else '' end as subdomain, array_to_string(l[-2:], '.') as registrable_domain, l[-1] as suffix,
  regexp_replace(original_archived_url, '#.*$', '') as normalized_url, {_PATH} as path, {_RX[4]} as query
from (select *, string_split(regexp_replace({_HOST}, ':\\d*$', ''), '.') as l from {_U})""",
    "url_normalize": f"""
select original_archived_url, {_RX[1]} || '://' || {_HOST} || {_CLEAN} as normalized, {_RX[1]} || '://' || {_HOST} || {_CLEAN} as canonical from {_U}""",
    "url_exclusion": f"""
select original_archived_url, regexp_matches(p, '{urls.EXCLUDED_PATH}') or scheme in ('mailto', 'tel', 'javascript')
  or (contains(p, '.') and list_last(string_split(p, '.')) in ({", ".join(f"'{e}'" for e in urls.EXTENSIONS)})) as excluded
from (select *, lower({_RX[3]}) as p, lower({_RX[1]}) as scheme from {_U})""",
    "branding_score": f"select original_archived_url, cast({_SCORE} as integer) as score from (select *, lower({_RX[3]}) as p from {_U})",
    "text_counts": f"""
select doc_id, cast(length(text) as integer) as characters, cast(len({_WORDS.format(t="text")}) as integer) as words,
  round(least(1.0, length(text) / 500.0::double) * 0.7::double + least(1.0, length(text)::double / (strlen(text) * 3) * 10) * 0.3::double, 3) as score from documents""",
    "boilerplate_ratio": f"""
select {_KEY}, case when length(meta_description) > 0 and length(extracted_text) > 0 then round(1.0::double - length(meta_description)::double / length(extracted_text), 3) end as ratio
from (select distinct {_KEY}, meta_description, extracted_text from {_P})""",
    "text_predicates": f"select {_KEY}, {_text(_SOFT)} as soft_404, {_text(_NAV)} as menu_only from (select distinct {_KEY}, document_title, extracted_text from {_P})",
    "noise_lines": rf"""
select {_KEY}, cast(length(regexp_replace(regexp_replace(array_to_string(kept, chr(10)), '^[\s\x{{a0}}\x{{85}}]+', ''), '[\s\x{{a0}}\x{{85}}]+$', '')) as integer) as characters, len(kept) <> len(l) as removed
from (select *, list_filter(l, lambda x: not regexp_matches(x, '(?i)(wayback|archive\.org|screenshot|toolbar)')) as kept
      from (select distinct {_KEY}, regexp_split_to_array(extracted_text, '\r\n|[\n\x{{0b}}\x{{0c}}\r\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]') as l from {_P} and extracted_text is not null))""",
    "content_dedupe": "select doc_id, sha256(text) as content_hash, row_number() over (partition by text order by doc_id) > 1 as duplicate_content_flag from documents",
    "page_check": f"""
with p as (select distinct {_KEY}, fetch_error, http_status, registrable_domain, temporal_distance_days, document_title, archive_toolbar_removed_flag, final_url, extracted_text, character_count from {_P}),
q as (select p.*, f.primary_domain, coalesce(character_count, 0) as chars, {_text(_SOFT)} as soft, {_text(_NAV)} as nav
      from p join (select firm_id, min(primary_domain) as primary_domain from firms group by 1) f using (firm_id))
select {_KEY}, character_count, soft as soft_404_flag, nav as likely_navigation_only,
  not (coalesce(fetch_error, '') <> '' or coalesce(http_status >= 400, false) or coalesce(registrable_domain <> '' and registrable_domain <> primary_domain, false) or soft) and chars >= 50 as usable_for_analysis,
  case when coalesce(fetch_error, '') <> '' then fetch_error when http_status >= 400 then 'http_' || http_status when registrable_domain <> '' and registrable_domain <> primary_domain then 'wrong_registrable_domain'
       when chars = 0 then 'empty_text' when soft then 'soft_404' end as exclusion_reason,
  array_to_string(list_filter([case when coalesce(fetch_error, '') <> '' then 'fetch_error' end, case when http_status >= 400 then 'http_error' end, case when registrable_domain <> '' and registrable_domain <> primary_domain then 'wrong_domain' end,
    case when temporal_distance_days > 548 then 'distant_snapshot' end, case when chars < 50 then 'short_text' end, case when soft then 'soft_404' end, case when nav then 'navigation_only' end,
    case when archive_toolbar_removed_flag then 'toolbar_stripped' end, case when registrable_domain = 'web.archive.org' then 'wayback_domain_leak' end], lambda x: x is not null), ',') as all_flags
from q""",
    "quality_summary": f"""
with s as (select firm_id, relative_timepoint, min(snapshot_status) as snapshot_status from snapshots group by 1, 2),
p as (select firm_id, relative_timepoint, count(*) as a, count(case when http_status = 200 and coalesce(fetch_error, '') = '' then 1 end) as ok, count(case when usable_for_analysis then 1 end) as u,
        avg(case when character_count <> 0 then character_count end) as c, bool_or(coalesce(soft_404_flag, false)) as f1, bool_or(coalesce(likely_navigation_only, false)) as f2, bool_or(coalesce(duplicate_content_flag, false)) as f3
      from (select distinct * exclude (fetch_timestamp) from {_P}) group by 1, 2)
select s.firm_id, s.relative_timepoint, snapshot_status, coalesce(a, 0) as pages_attempted, coalesce(ok, 0) as pages_success, coalesce(u, 0) as pages_usable, coalesce(a, 0) - coalesce(u, 0) as pages_excluded,
  round(coalesce(c, 0.0::double), 1) as avg_text_chars,
  case when f1 or f2 or f3 then '[' || array_to_string(list_filter([case when f3 then '"duplicate_content_flag"' end, case when f2 then '"likely_navigation_only"' end, case when f1 then '"soft_404_flag"' end], lambda x: x is not null), ',') || ']' end as flags
from s left join p using (firm_id, relative_timepoint)""",
    "review_sample": f"""
with p as (select distinct * exclude (fetch_timestamp) from {_P}), u as (select * from p where usable_for_analysis),
pool as (select * from u where (select count(*) from u) >= 15 union all select * from p where (select count(*) from u) < 15)
select {_KEY}, usable_for_analysis,
  array_to_string(list_filter([case when soft_404_flag then 'soft_404_flag' end, case when likely_navigation_only then 'likely_navigation_only' end, case when duplicate_content_flag then 'duplicate_content_flag' end], lambda x: x is not null), ',') as quality_flags, left(coalesce(extracted_text, ''), 2000) as extracted_text
from pool order by sha256(coalesce(firm_id, '') || '|' || coalesce(relative_timepoint, '') || '|' || coalesce(original_archived_url, '') || '|42'), {_KEY} limit 15""",
    "manifest_counts": """
select (select count(*) from (select distinct * from firms)) as firms, (select count(*) from snapshots) as snapshots, (select count(*) from snapshots where snapshot_status = 'selected') as selected,
  (select count(*) from pages) as pages, (select count(*) from pages where usable_for_analysis) as usable""",
    "placeholder_rows": """
select firm_id, relative_timepoint, target_date, cast(null as varchar) as original_archived_url, false as usable_for_analysis, snapshot_status as exclusion_reason
from (select distinct * exclude (discovered_at) from snapshots) where snapshot_status <> 'selected'""",
    "crawl_bfs": _CRAWL,
    "url_query_filter": f"""
with u as (select original_archived_url as url, {_RX[1]} || '://' || {_HOST} || {_CLEAN} as head, {_RX[4]} as q from {_U}),
p as (select url, x, i, split_part(x, '=', 1) as k from (select url, string_split(q, '&') as l from u where q <> ''), unnest(l) with ordinality t(x, i)),
o as (select *, min(i) over (partition by url, k) as first from p where not (contains(k, 'utm_') or contains(k, 'fbclid') or contains(k, 'gclid'))),
j as (select url, string_agg(x, '&' order by first, i) as q from o group by 1)
select u.url as original_archived_url, u.head || coalesce('?' || j.q, '') as normalized from u left join j using (url)""",
    "replay_url": f"""
with c as (select distinct original, timestamp, case when regexp_matches(trim(original), '^https?://') then trim(original) else 'https://' || trim(original) end as own from captures where regexp_full_match(timestamp, '[0-9]{{14}}')),
e as (select *, array_to_string(list_transform(string_split(own, ''), lambda c: case when regexp_full_match(c, '{_SAFE}') then c else url_encode(c) end), '') as quoted from c)
select original, timestamp, 'https://web.archive.org/web/' || timestamp || 'id_/' || quoted as replay, url_decode(replace(quoted, '+', '%2B')) as unwrapped, true as is_archive from e""",
    "capture_variants": f"select firm_id, cast(seed_ord as integer) as seed_ord, requested_url, timestamp, original, row_ord from {_VARIANTS}",
    "discover_snapshots": f"""
with s as ({_select(_FIRMS, f"select * from {_VARIANTS}", "2026-07-13", "desc")})
select s.firm_id, relative_timepoint, snapshot_status, archive_timestamp, temporal_distance_days, case when snapshot_status <> 'future_unavailable' then 'capture_index' end as capture_source,
  case when snapshot_status <> 'future_unavailable' then w end as requested_url, case when snapshot_status <> 'future_unavailable' then '["' || array_to_string(tried, '","') || '"]' end as fallback_attempts,
  relative_timepoint = 'event' as noted from s join {_TRIED} t on t.firm_id = s.firm_id""",
    "future_observations": "select company, relative_timepoint, target_year from (select distinct * exclude (discovered_at) from snapshots) where snapshot_status = 'future_unavailable'",
    "firm_identity": f"select rank, cast(rank as varchar) as firm_id, 'r1' as run_id, company from {_FIRMS}",
    "capture_rows": "select row_ord, " + ", ".join(f"coalesce({c}, '') as {c}" for c in ("urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "length", "redirect")) + " from captures where row_ord is not null",
    "cache_keys": f"select distinct archive_timestamp, wayback_replay_url, sha256(archive_timestamp || '|' || wayback_replay_url) as key from {_P} and archive_timestamp is not null and wayback_replay_url is not null",
    "csv_round_trip": "select firm_id, relative_timepoint, target_date, observation_is_future, temporal_distance_days, strftime(discovered_at, '%Y-%m-%d %H:%M:%S') as discovered from snapshots",
    "parquet_round_trip": f"select firm_id, company, event_year, wayback_tier from {_FIRMS}",
    "link_policy": f"""
with u as (select original_archived_url as url, min(discovered_from_url) as d, min(crawl_depth) as depth from {_P} group by 1),
s as (select *, lower({_part("url", 3)}) as p, {_SITE.format(h=_part("url", 2))} as site from u)
select url as original_archived_url, {_follow("url", "site")} as follow, site = {_SITE.format(h=_part("d", 2))} as same_site, case when d is null then 0 else 1 end as home, depth,
  -cast({_SCORE} as integer) as score, cast(length(p) as integer) as size from s""",
    "html_metadata": f"""
select {_KEY}, {_strip("document_title")} as document_title, nullif(meta_description, '') as meta_description, html_lang, {_HEADING} as h1_text, cast(null as varchar) as og_title,
  case when {_HEADING} is null then 0 else 1 end as headings from {_HTML_PAGES}""",
    "html_text": f"""
with p as (select {_KEY}, list_prepend(coalesce(h1_text, ''), string_split(coalesce(extracted_text, ''), chr(10))) as l from {_HTML_PAGES}),
q as (select {_KEY}, list_filter(list_transform(l, lambda x: {_strip("x")}), lambda x: x <> '') as visible, list_filter(list_transform(l, lambda x: {_strip(f"regexp_replace(x, '{_WHITE}+', ' ', 'g')")}), lambda x: x <> '') as main from p),
r as (select {_KEY}, array_to_string(list_prepend('Kontakt', visible), ' ') as whole, case when len(main) > 0 then array_to_string(main, chr(10)) else 'Kontakt' end as main, len(main) > 0 as has from q)
select {_KEY}, case when has then 'main_blocks' else 'visible_text' end as extraction_method, sha256(main) as text_hash, cast(length(whole) as integer) as full_chars, round(1.0::double - length(main)::double / length(whole), 3) as ratio from r""",
    "html_links": f"""
select {_KEY}, pos, link from (select {_KEY}, unnest([{_RX[1]} || '://' || {_RX[2]} || '/kontakt', 'http://www.andere.example/a b']) as link, unnest([0, 1]) as pos from {_HTML_PAGES})""",
    "html_by_pattern": f"""
select {_KEY}, case when document_title is not null then trim(replace(replace(replace(replace(document_title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) end as title,
  '/kontakt /web/20150301000000/http://www.andere.example/a%20b' as targets from {_HTML_PAGES}""",
    "homepage_visuals": """
with s as (select firm_id, relative_timepoint, min(rank) as r, min(snapshot_status) as st from snapshots group by 1, 2)
select firm_id, relative_timepoint, case when r % 2 = 0 then 'b' when r % 7 + 10 >= r % 5 + 10 and r % 7 + 10 >= r % 3 + 12 then 'a' when r % 5 + 10 >= r % 3 + 12 then 'b' else 'c' end as h1_text,
  cast(case when r % 2 = 0 then r % 5 + 10 else greatest(r % 7 + 10, r % 5 + 10, r % 3 + 12) end as double) as h1_font_size_px,
  cast(case when r % 11 = 0 then 0.0 when r % 2 = 0 then 0.7 else 0.4 end as double) as visual_extraction_confidence, left(sha256(firm_id || '|' || relative_timepoint), 16) || '.png' as screenshot_path
from s where st = 'selected'""",
    "stream_captures": "select distinct firm_id, timestamp, original from captures",
}
