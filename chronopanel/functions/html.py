"""HTML to columns. Arrow UDFs over the standard library's parser; a regex subset for what Spark can express by itself."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import urls

_NAMES = "document_title meta_description meta_keywords html_lang canonical_url og_title og_description og_site_name h1_text h2_text headings_json".split()
_HEADING = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())])
METADATA = T.StructType([*[T.StructField(n, T.StringType()) for n in _NAMES], T.StructField("headings", T.ArrayType(_HEADING))])
TEXT = T.StructType([T.StructField("extracted_text", T.StringType()), T.StructField("extraction_method", T.StringType()), T.StructField("full_chars", T.IntegerType()), T.StructField("language", T.StringType())])
_HIDDEN = frozenset("script style noscript template head".split())
_CHROME = frozenset("nav header footer aside form".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("p div section article main h1 h2 h3 h4 h5 h6 li ul ol table tr td th blockquote pre br dd dt dl figure figcaption address header footer nav aside form body".split())
#: Words that a block in a page's furniture needs to be text, and greatest share of them in links.
DENSE_WORDS, DENSE_LINKS = 10, 0.3
_SPACE = re.compile(r"\s+")


class _Reader(HTMLParser):
    """One pass: metadata, headings, links, all visible text and main text with a line for each block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.og: dict[str, str] = {}
        self.title: str | None = None
        self.lang: str | None = None
        self.canonical: str | None = None
        self.seen_title = False
        self.seen: set[str] = set()
        self.links: list[str] = []
        self.headings: list[list] = []
        self.open: list[str] = []
        self.full: list[str] = []
        self.main: list[list[str]] = [[]]
        self.rest: list[list[tuple[str, bool]]] = [[]]  # blocks of navigation and the like: text, and whether it is a link
        self.in_title: list[str] | None = None
        self.in_heading: list | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "html" and self.lang is None:
            self.lang = a.get("lang")
        elif tag == "meta":
            if a.get("http-equiv", "").lower() == "content-language":
                self.meta.setdefault("content-language", a.get("content", ""))
            if (n := a.get("name", "")) and f"n:{n}" not in self.seen:
                self.seen.add(f"n:{n}")
                self.meta[n] = a.get("content", "")
            if (p := a.get("property", "")) and f"p:{p}" not in self.seen:
                self.seen.add(f"p:{p}")
                self.og[p] = a.get("content", "")
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split() and self.canonical is None:
            self.canonical = a.get("href", "")
        elif tag == "a" and "href" in a:
            self.links.append(a["href"].strip())
        elif tag == "title" and not self.seen_title and "svg" not in self.open:
            self.seen_title, self.in_title = True, []
        if tag in _BLOCK:
            self.main.append([])
            self.rest.append([])
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.in_heading = [int(tag[1]), []]
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass
        if tag in _BLOCK:
            self.main.append([])
            self.rest.append([])
        if tag == "title" and self.in_title is not None:
            self.title, self.in_title = "".join(self.in_title).strip(), None
        if self.in_heading is not None and tag == f"h{self.in_heading[0]}":
            text = " ".join(x for x in (s.strip() for s in self.in_heading[1]) if x)
            if text:
                self.headings.append([self.in_heading[0], text])
            self.in_heading = None

    def handle_data(self, data: str) -> None:
        if self.in_title is not None:
            self.in_title.append(data)
        if self.in_heading is not None:
            self.in_heading[1].append(data)
        if not data.strip() or any(t in _HIDDEN for t in self.open):
            return
        self.full.append(data.strip())
        if not any(t in _CHROME for t in self.open):
            self.main[-1].append(_SPACE.sub(" ", data))
        else:
            self.rest[-1].append((_SPACE.sub(" ", data), "a" in self.open))


def read(html: bytes | None) -> _Reader:
    """Parse a page, whatever its state; null and empty give an empty result."""
    out = _Reader()
    if html:
        out.feed(bytes(html).decode("utf-8", errors="replace"))
        out.close()
    return out


def metadata_of(html: bytes | None) -> dict:
    r = read(html)
    by_level = [h for level in range(1, 7) for h in r.headings if h[0] == level]
    join = lambda level: " | ".join(t for n, t in r.headings if n == level) or None
    return {
        "document_title": r.title, "meta_description": r.meta.get("description") or None, "meta_keywords": r.meta.get("keywords") or None, "html_lang": r.lang,
        "canonical_url": r.canonical or None, "og_title": r.og.get("og:title") or None, "og_description": r.og.get("og:description") or None,
        "og_site_name": r.og.get("og:site_name") or None, "h1_text": join(1), "h2_text": join(2),
        "headings_json": json.dumps([{"level": n, "text": t} for n, t in by_level], ensure_ascii=False) if by_level else None,
        "headings": [{"level": n, "text": t} for n, t in by_level],
    }


def _dense(blocks: list[list[tuple[str, bool]]]) -> list[str]:
    """Blocks of furniture that read as text: enough words, few of them in links."""
    out = []
    for block in blocks:
        text = " ".join("".join(t for t, _ in block).split())
        linked = sum(len(t.split()) for t, link in block if link)
        n = len(text.split())
        if n >= DENSE_WORDS and linked <= DENSE_LINKS * n:
            out.append(text)
    return out


def text_of(html: bytes | None) -> dict:
    """Main text, a line for each block; without any the dense blocks of the page's furniture, else all visible text; the method's name; characters of all
    visible text; the language that the page gives itself (lang, else content-language, else og:locale)."""
    r = read(html)
    full = " ".join(r.full)
    main = "\n".join(x for x in (" ".join("".join(p).split()) for p in r.main) if x)
    dense = "" if main else "\n".join(_dense(r.rest))
    text, method = (main, "main_blocks") if main else (dense, "dense_blocks") if dense else (full, "visible_text") if full else (None, None)
    named = r.lang or r.meta.get("content-language") or r.meta.get("language") or r.og.get("og:locale") or None
    return {"extracted_text": text, "extraction_method": method, "full_chars": len(full), "language": named if text else None}


@F.pandas_udf(METADATA)
def extract_metadata(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in html:
        yield pd.DataFrame([metadata_of(x) for x in s], columns=METADATA.fieldNames())


@F.pandas_udf(TEXT)
def extract_text(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in html:
        yield pd.DataFrame([text_of(x) for x in s], columns=TEXT.fieldNames())


_WRAPPED = re.compile(r"^https?://web\.archive\.org/web/\d{14}[a-z_]*/(.+)$", re.I)


def resolve(href: str, base: str) -> str | None:
    """Original address that a link leads to; null for links within the page, empty ones and archive paths that lead nowhere."""
    if not href or href.startswith("#"):
        return None
    own = f"https://{urls.ARCHIVE_HOST}{href}" if href.startswith("/web/") else None
    try:
        full = own or urljoin(base, href)
    except ValueError:
        return None
    m = _WRAPPED.match(full.strip())
    return unquote(m.group(1)) if m else None if own else full


def links(pages: DataFrame, key: list[str], html: str = "content", base: str = "url") -> DataFrame:
    """``key, pos, link`` for every link of every page, in document order, repeated ones kept."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*key).schema.fields)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                found = [x for x in (resolve(h, row[-1] or "") for h in read(row[-2]).links) if x]
                out += [(*row[: len(key)], i, x) for i, x in enumerate(found)]
            yield pd.DataFrame(out, columns=[*key, "pos", "link"])

    return pages.select(*key, html, base).mapInPandas(each, f"{schema}, pos int, link string")


def first_tag(html: Column, tag: str) -> Column:
    """Text of the first element of a kind, by regular expression; null if there is none."""
    got = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.when(html.rlike(rf"(?i)<{tag}\b"), F.trim(F.regexp_replace(got, r"<[^>]+>", "")))


def hrefs(html: Column) -> Column:
    """Targets of links in double quotes, by regular expression, without those within the page."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?href="([^"]*)"'), F.lit(1)), F.trim), lambda x: (x != "") & ~x.startswith("#"))
