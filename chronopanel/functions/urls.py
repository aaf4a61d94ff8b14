"""URL functions as column expressions (RFC 3986 split; nothing here is a Python UDF except the re-encoding of query strings)."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import parse_qs, urlencode

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The archive's host and the shape of its addresses.
ARCHIVE_HOST = "web.archive.org"
ARCHIVE_URL = r"(?i)^https?://web\.archive\.org/web/(\d{14})([a-z_]*)/(.+)$"
SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# File extensions and paths that aren't pages.
EXTENSIONS = "jpg jpeg png gif svg webp ico css js pdf zip rar mp3 mp4 avi mov wmv doc docx xls xlsx ppt pptx xml rss atom".split()
EXCLUDED_PATH = r"(/wp-json/|/feed/?$|/search|/login|/logout|/cart|/tag/|/category/|/calendar|/trackback|/cgi-bin/|\.php\?|/media/|/assets/)"
# Public suffixes of more than one label; a parameter where it matters.
SUFFIXES = "co.uk org.uk ac.uk gov.uk me.uk com.au net.au org.au co.nz co.jp or.jp co.at or.at ac.at gv.at com.br com.tr com.mx com.cn co.za co.in com.sg com.hk com.pl".split()


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), SPLIT, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def raw_path(url: Column) -> Column:
    return _part(url, 3)


def path(url: Column) -> Column:
    """Path, ``/`` if empty."""
    return F.when(raw_path(url) == "", "/").otherwise(raw_path(url))


def query(url: Column) -> Column:
    return _part(url, 4)


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def is_archive_url(url: Column) -> Column:
    """Whether the host is the archive's, in any case and with or without a trailing dot; null is false."""
    return F.coalesce(F.regexp_replace(F.lower(netloc(url)), r"\.$", "") == ARCHIVE_HOST, F.lit(False))


def percent_decode(text: Column) -> Column:
    """Percent-decoding that keeps ``+``; text with an invalid escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def parse_archive_url(url: Column) -> Column:
    """``struct(timestamp, modifier, original)`` of an archive address, null for any other."""
    own = F.trim(url)
    return F.when(
        own.rlike(ARCHIVE_URL),
        F.struct(F.regexp_extract(own, ARCHIVE_URL, 1).alias("timestamp"), F.regexp_extract(own, ARCHIVE_URL, 2).alias("modifier"), percent_decode(F.regexp_extract(own, ARCHIVE_URL, 3)).alias("original")),
    )


def unwrap(url: Column) -> Column:
    """The original address inside an archive address; any other address unchanged."""
    return F.when(F.trim(url).rlike(ARCHIVE_URL), percent_decode(F.regexp_extract(F.trim(url), ARCHIVE_URL, 3))).otherwise(url)


def build_replay_url(original: Column, timestamp: Column, modifier: str = "id_") -> Column:
    """Archive address of an original address at a timestamp, percent-encoded but for ``:/?=&%+#`` and unreserved characters."""
    own = F.trim(original)
    full = F.when(own.rlike("^https?://"), own).otherwise(F.concat(F.lit("https://"), own))
    safe = r"^[A-Za-z0-9_.~:/?=&%+#-]$"
    one = lambda c: F.when(c.rlike(safe), c).otherwise(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")))
    plain = full.rlike(r"^[A-Za-z0-9_.~:/?=&%+#-]*$")
    quoted = F.when(plain, full).otherwise(F.array_join(F.transform(F.filter(F.split(full, ""), lambda c: c != ""), one), ""))
    return F.concat(F.lit(f"https://{ARCHIVE_HOST}/web/"), timestamp, F.lit(f"{modifier}/"), quoted)


def _clean_path(url: Column) -> Column:
    p = path(url)
    return F.when((p != "/") & p.endswith("/"), F.regexp_replace(p, "/+$", "")).otherwise(p)


def normalize_original(url: Column) -> Column:
    """Scheme (https if none), lower-case host and path without trailing slash; parameters, query and fragment dropped."""
    own = unwrap(F.trim(url))
    s = scheme(own)
    bare = F.regexp_replace(_clean_path(own), r";[^/]*$", "")
    return F.concat(F.when(s == "", "https").otherwise(s), F.lit("://"), F.lower(netloc(own)), bare)


def labels(host: Column) -> Column:
    """Labels of a host without port and credentials."""
    return F.split(F.regexp_replace(F.regexp_replace(F.lower(host), r"^.*@", ""), r":\d*$|\.$", ""), r"\.")


def suffix(url: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """Public suffix of the host: the longest listed one of two labels, else the last label; empty for a host of one label."""
    part = labels(netloc(unwrap(url)))
    two = F.array_join(F.slice(part, F.greatest(F.size(part) - 1, F.lit(1)), F.lit(2)), ".")
    return F.when(F.size(part) < 2, "").when((F.size(part) > 2) & two.isin(*suffixes), two).otherwise(F.element_at(part, -1))


def registrable_domain(url: Column, suffixes: list[str] = SUFFIXES, wrapped: bool = True) -> Column:
    """Public suffix and the label before it; the whole host if it has no suffix. ``wrapped``: the address may be an archive address."""
    own = unwrap(url) if wrapped else url
    part = labels(netloc(own))
    take = F.when((F.size(part) > 2) & F.array_join(F.slice(part, F.greatest(F.size(part) - 1, F.lit(1)), F.lit(2)), ".").isin(*suffixes), 3).otherwise(2)
    return F.when(F.size(part) < 2, F.lower(netloc(own))).otherwise(F.array_join(F.slice(part, F.greatest(F.size(part) - take + 1, F.lit(1)), take), "."))


def subdomain(url: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """What stands before the registrable domain."""
    part = labels(netloc(unwrap(url)))
    rest = F.size(part) - F.size(F.split(registrable_domain(url, suffixes), r"\."))
    return F.when(rest > 0, F.array_join(F.slice(part, F.lit(1), F.greatest(rest, F.lit(1))), ".")).otherwise("")


def parse_domain(url: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """``struct(scheme, hostname, subdomain, registrable_domain, suffix, normalized_url, path, query)``."""
    own = unwrap(url)
    return F.struct(
        F.when(scheme(own) == "", "https").otherwise(scheme(own)).alias("scheme"), F.lower(netloc(own)).alias("hostname"), subdomain(url, suffixes).alias("subdomain"),
        registrable_domain(url, suffixes).alias("registrable_domain"), suffix(url, suffixes).alias("suffix"), strip_fragment(own).alias("normalized_url"), path(own).alias("path"), query(own).alias("query"),
    )


def same_registrable_domain(a: Column, b: Column) -> Column:
    return registrable_domain(a) == registrable_domain(b)


def _requery(patterns: list[str]):
    @F.pandas_udf(T.StringType())
    def requery(queries: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for q in queries:
            yield q.map(lambda x: None if x is None else urlencode({k: v for k, v in parse_qs(x, keep_blank_values=True).items() if not any(p in k for p in patterns)}, doseq=True))

    return requery


def normalize(url: Column, strip_query: bool = False, exclude_query_patterns: list[str] | None = None) -> Column:
    """Unwrapped, host in lower case, no trailing slash, no parameters, no fragment; query dropped, filtered by key, or kept.

    Filtering re-encodes the query with repeated keys together at their first place; that alone needs Python. An address without query
    doesn't pass through it when callers split on ``query(url) == ''`` first.
    """
    own = unwrap(url)
    s, q = scheme(own), query(own)
    if strip_query:
        q = F.lit("")
    elif exclude_query_patterns:
        q = _requery(exclude_query_patterns)(q)
    bare = F.regexp_replace(_clean_path(own), r";[^/]*$", "")
    head = F.concat(F.when(s == "", "").otherwise(F.concat(s, F.lit(":"))), F.when(netloc(own) == "", "").otherwise(F.concat(F.lit("//"), F.lower(netloc(own)))), bare)
    return F.concat(head, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def is_excluded(url: Column, extract_pdf: bool = False, wrapped: bool = True) -> Column:
    """Whether a crawl leaves an address out: by path, by scheme or by extension (the text after the path's last dot)."""
    own = unwrap(url) if wrapped else url
    p = F.lower(raw_path(own))
    ext = F.when(F.contains(p, F.lit(".")), F.substring_index(p, ".", -1)).otherwise("")
    listed = [e for e in EXTENSIONS if not (extract_pdf and e == "pdf")]
    return p.rlike(EXCLUDED_PATH) | scheme(own).isin("mailto", "tel", "javascript") | ext.isin(*listed)


def should_follow(url: Column, domain: Column, extract_pdf: bool = False, wrapped: bool = True) -> Column:
    return ~is_excluded(url, extract_pdf, wrapped) & (registrable_domain(url, wrapped=wrapped) == domain)


def branding_score(url: Column, patterns: dict[str, list[str]], prefer_german: bool, wrapped: bool = True) -> Column:
    """Sum of the weights of all patterns that the path contains, and up to 30 points for a short path."""
    p = F.lower(raw_path(unwrap(url) if wrapped else url))
    total = F.greatest(F.lit(0), F.lit(30) - F.length(p))
    for lang, top, more in (("de", 100, 10 if prefer_german else 0), ("en", 50, 0)):
        for i, pattern in enumerate(patterns.get(lang, [])):
            total = total + F.when(F.contains(p, F.lit(pattern.lower())), top - i + more).otherwise(0)
    return total.cast("int")


def priority(url: Column, depth: Column, is_homepage: Column, patterns: dict[str, list[str]], prefer_german: bool) -> Column:
    """Ordering struct: homepage first, then depth, score (high first), length of the path."""
    return F.struct(F.when(is_homepage, 0).otherwise(1).alias("home"), depth.alias("depth"), (-branding_score(url, patterns, prefer_german)).alias("score"), F.length(raw_path(unwrap(url))).alias("size"))


def fill_template(template: Column, domain: Column) -> Column:
    return F.replace(template, F.lit("{domain}"), domain)
