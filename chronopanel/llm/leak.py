"""Passages of evaluation items in documents, by template canonicalisation.

Words are runs of letters or digits of the composed text (NFC), compared in lower case. Numbers, units and names become typed placeholders,
so a window of words becomes a template. Documents are read once: windows whose template may occur in an item (by a table of bits of a fixed size)
are hash-joined with the items' windows, and the fillers of both are compared slot by slot. Equal fillers are an exact leak; different fillers that map one to
one over a whole run of windows are a re-parameterised copy of the item.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Words of a window, and items up to which a word that is only written with a capital counts as a name.
WINDOW, NAME_ITEMS = 13, 3
#: Windows on one alignment that a re-parameterised copy needs (of 200 planted copies at sf0.1 12 find 196 and nothing else, 8 find 199 and 42 others), and greatest
#: share of placeholders in them.
RUN, SLOTS = 12, 0.5
#: Bits of the tables of words and of templates, whatever the number of items: 2 and 16 MB. A false hit in the first may hide a changed copy, never an exact one; one
#: in the second costs a row that the join drops.
WORD_BITS, TEMPLATE_BITS = 24, 27
WORD = re.compile(r"[^\W_]+")
# Units of measure that become one placeholder.
UNITS = frozenset("mm cm m km kg g t kw kwh mw nm bar l h min s °c c v a percent prozent pourcent millionen million millions euro eur usd".split())
NUMBER, UNIT, NAME = "\x01", "\x02", "\x03"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Words of a text as they are written; null gives none."""
    return WORD.findall(text if text is None or text.isascii() else unicodedata.normalize("NFC", text)) if text else []


def _hash(symbol: str) -> int:
    return xxhash.xxh64_intdigest(symbol.encode("utf-8", "surrogatepass"))


class Bits(NamedTuple):
    """A set of hashes by their highest bits; a fixed size, no hash is missed."""

    size: int
    table: np.ndarray

    def has(self, value: int) -> bool:
        at = value >> (64 - self.size)
        return bool(self.table[at >> 3] >> (at & 7) & 1)

    def all(self, values: np.ndarray) -> np.ndarray:
        at = (values >> np.uint64(64 - self.size)).astype(np.int64)
        return (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bits(hashes: DataFrame, size: int) -> Bits:
    """The set of a table's only column ``h``. One table of bits comes to the driver from each of eight parts."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << (size - 3), dtype=np.uint8)
        for b in batches:
            at = (b["h"].to_numpy().astype(np.int64).view(np.uint64) >> np.uint64(64 - size)).astype(np.int64)
            np.bitwise_or.at(table, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        if table.any():
            yield pd.DataFrame({"t": [table.tobytes()]})

    out = np.zeros(1 << (size - 3), dtype=np.uint8)
    for r in hashes.coalesce(8).mapInPandas(fill, "t binary").toLocalIterator():
        out |= np.frombuffer(r["t"], dtype=np.uint8)
    return Bits(size, out)


class Vocabulary(NamedTuple):
    """Words that the items use, and those of them that are names."""

    known: Bits
    names: Bits


def vocabulary(items: DataFrame) -> Vocabulary:
    """Words of all items. A name is written with a capital, not only at a passage's start, nowhere without, and stands in at most ``NAME_ITEMS`` items. It
    depends on all items together, not on how they are split."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text in zip(b["eval_id"], b["passage"], strict=True):
                out += {(i, _hash(w.lower()), w[:1].isupper(), k > 0) for k, w in enumerate(words(text))}
            h = np.array([x[1] for x in out], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"eval_id": [x[0] for x in out], "h": h, "capital": [x[2] for x in out], "inside": [x[3] for x in out]})

    seen = items.mapInPandas(explode, "eval_id long, h long, capital boolean, inside boolean")
    per = seen.groupBy("h").agg(F.min("capital").alias("always"), F.max(F.col("capital") & F.col("inside")).alias("inside"), F.count_distinct("eval_id").alias("n"))
    per = materialise(per.select("h", (F.col("always") & F.col("inside") & (F.col("n") <= NAME_ITEMS)).alias("name")), "item-words")
    return Vocabulary(bits(per.select("h"), WORD_BITS), bits(per.where("name").select("h"), WORD_BITS))


def symbol(word: str, v: Vocabulary) -> str:
    """Type of a word, or the word. A known word's type doesn't depend on its case; an unknown word with a capital is a name."""
    low = word.lower()
    if any(c.isdigit() for c in low):
        return NUMBER
    if low in UNITS:
        return UNIT
    h = _hash(low)
    if v.names.has(h):
        return NAME
    return low if v.known.has(h) or not word[:1].isupper() else NAME


def window_hashes(values: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Polynomial hash of every window of ``size`` values, modulo 2**64, mixed so that its highest bits can be used."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = values[:n].copy()
        for k in range(1, size):
            out = out * _BASE + values[k : k + n]
        return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def windows(table: DataFrame, key: str, text: str, v: Vocabulary, size: int = WINDOW, only: Bits | None = None) -> DataFrame:
    """``key, pos, template, low, symbols`` of the windows of every text; if ``only``, of those whose template may be in it. Each different word of a batch is typed once."""
    schema = f"{key} long, pos int, template long, low array<string>, symbols array<string>"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for b in batches:
            out = []
            for i, t in zip(b[key], b[text], strict=True):
                w = words(t)
                if len(w) < size:
                    continue
                if len(cache) > 500_000:
                    cache.clear()
                for x in set(w).difference(cache):
                    cache[x] = _hash(symbol(x, v))
                h = window_hashes(np.array([cache[x] for x in w], dtype=np.uint64), size)
                for k in np.flatnonzero(only.all(h)) if only else range(len(h)):
                    part = w[k : k + size]
                    out.append((i, int(k), int(h[k].astype(np.int64)), [x.lower() for x in part], [symbol(x, v) for x in part]))
            yield pd.DataFrame(out, columns=[key, "pos", "template", "low", "symbols"])

    return table.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull()).mapInPandas(scan, schema)


def matches(documents: DataFrame, evaluation_items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``eval_id, doc_id, eval_pos, doc_pos, changed, slots, pairs``: windows of items found in documents.

    ``changed``: slots whose filler differs (0: word for word); ``slots``: placeholders; ``pairs``: fillers of item and document. Both sides meet
    in a join on the template, which Spark broadcasts only if the items' windows are small.
    """
    items = evaluation_items.select("eval_id", "passage").where(F.col("eval_id").isNotNull() & F.col("passage").isNotNull()).distinct()
    v = vocabulary(items)
    right = materialise(windows(items, "eval_id", "passage", v, size), "item-windows")
    left = windows(documents, "doc_id", "text", v, size, bits(right.select(F.col("template").alias("h")), TEMPLATE_BITS))
    right = right.select("eval_id", F.col("pos").alias("eval_pos"), "template", F.col("low").alias("eval_words"), "symbols")
    both = left.select("doc_id", F.col("pos").alias("doc_pos"), "template", F.col("low").alias("doc_words"), F.col("symbols").alias("doc_symbols")).join(right, "template").where(F.col("symbols") == F.col("doc_symbols"))
    slots = F.filter(F.arrays_zip("symbols", "eval_words", "doc_words"), lambda x: x["symbols"].isin(NUMBER, UNIT, NAME))
    return both.select(
        "eval_id", "doc_id", "eval_pos", "doc_pos", F.size(F.filter(slots, lambda x: x["eval_words"] != x["doc_words"])).alias("changed"), F.size(slots).alias("slots"),
        F.array_distinct(F.transform(slots, lambda x: F.struct(x["eval_words"].alias("e"), x["doc_words"].alias("d")))).alias("pairs"),
    )


def found(documents: DataFrame, evaluation_items: DataFrame) -> DataFrame:
    """``eval_id, doc_id``: documents with at least a window of the item's passage word for word."""
    return matches(documents, evaluation_items).where(F.col("changed") == 0).select("eval_id", "doc_id").distinct()


def _one_to_one(pairs: Column) -> Column:
    n = F.size(pairs)
    return (n == F.size(F.array_distinct(F.transform(pairs, lambda p: p["e"])))) & (n == F.size(F.array_distinct(F.transform(pairs, lambda p: p["d"]))))


def report(documents: DataFrame, evaluation_items: DataFrame, run: int = RUN) -> DataFrame:
    """``eval_id, doc_id, exact_windows, changed_windows, changed_fillers``: leaks word for word, and copies with other numbers, units and names.

    Windows are taken together along the alignment of item and document. A copy needs at least ``run`` windows on one alignment (or all that the item
    has), at most ``SLOTS`` of their words placeholders, and fillers that map one to one over all of them.
    """
    got = matches(documents, evaluation_items).dropDuplicates(["eval_id", "doc_id", "eval_pos", "doc_pos"])
    own = evaluation_items.select("eval_id", "passage").where(F.col("eval_id").isNotNull() & F.col("passage").isNotNull())
    line = got.groupBy("eval_id", "doc_id", (F.col("doc_pos") - F.col("eval_pos")).alias("shift")).agg(
        F.count_if(F.col("changed") == 0).alias("exact"), F.count(F.lit(1)).alias("n"), F.sum("slots").alias("slots"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs")
    )
    most = own.groupBy("eval_id").agg(F.max(F.size(F.regexp_extract_all("passage", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("words"))
    line = line.join(most, "eval_id")
    enough = F.col("n") >= F.least(F.lit(run), F.greatest(F.lit(1), F.col("words") - (WINDOW - 1)))
    changed = F.filter("pairs", lambda p: p["e"] != p["d"])
    copy = enough & (F.col("slots") <= SLOTS * WINDOW * F.col("n")) & _one_to_one(F.col("pairs")) & (F.size(changed) > 0)
    kept = line.where((F.col("exact") > 0) | copy)
    return kept.groupBy("eval_id", "doc_id").agg(
        F.sum("exact").alias("exact_windows"), F.sum(F.when(copy, F.col("n") - F.col("exact")).otherwise(0)).alias("changed_windows"), F.max(F.when(copy, F.size(changed)).otherwise(0)).alias("changed_fillers")
    )
