"""Counts, scores and predicates over extracted text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = "\r\n|[\n\u000b\u000c\r\u001c-\u001e\u0085\u2028\u2029]"
# Markers of archive furniture, of error pages and of menus.
NOISE = r"(?i)(wayback|archive\.org|screenshot|toolbar)"
SOFT_404 = "(404|not found|seite nicht gefunden|page not found|error 404)"
MENU_TERMS = "home kontakt contact impressum datenschutz privacy login".split()


def words(text: Column) -> Column:
    """Words between Unicode white space; null and empty text give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def quality_score(text: Column, size: Column) -> Column:
    """Length against 500 characters (0.7) and text against bytes of the page (0.3), three decimals; 0 without text."""
    n = F.length(text)
    score = F.least(F.lit(1.0), n / 500) * 0.7 + F.least(F.lit(1.0), n / F.greatest(size, F.lit(1)) * 10) * 0.3
    return F.when(n > 0, F.round(score, 3)).otherwise(0.0)


def boilerplate_ratio(text: Column, full: Column) -> Column:
    """Share of the visible text that isn't main text, three decimals; may be negative; null if either is empty."""
    return F.when((F.length(text) > 0) & (F.length(full) > 0), F.round(1.0 - F.length(text) / F.length(full), 3))


def strip_noise(text: Column) -> Column:
    """``struct(text, removed)``: lines with archive furniture dropped, ends trimmed."""
    lines = F.split(text, LINE_END)
    kept = F.filter(lines, lambda x: ~x.rlike(NOISE))
    return F.when(text.isNotNull(), F.struct(F.regexp_replace(F.array_join(kept, "\n"), r"(?U)^\s+|\s+$", "").alias("text"), (F.size(kept) != F.size(lines)).alias("removed")))


def soft_404(text: Column, title: Column) -> Column:
    own = F.coalesce(text, F.lit(""))
    return F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), own)).rlike(SOFT_404) & (F.length(own) < 300)


def menu_only(text: Column) -> Column:
    """No text, fewer than 30 words, or six menu terms among the first 40 of fewer than 120 words."""
    w = words(text)
    hits = F.size(F.filter(F.slice(w, 1, 40), lambda x: F.btrim(F.lower(x), F.lit(".,;:")).isin(*MENU_TERMS)))
    return (F.size(w) < 30) | ((hits >= 6) & (F.size(w) < 120))
