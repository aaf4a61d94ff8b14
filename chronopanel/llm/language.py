"""Languages of pages and of their stretches, by hyperdimensional profiles. See :mod:`hdlang`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hdlang, layout, pages

#: Words that a paragraph needs to be given a language of its own, and by how much its cosine must exceed that of the page's language.
PARAGRAPH_WORDS = 5
MARGIN = 0.15
#: Cosine below which a text is in none of the languages. That of two unrelated texts is about one by the root of ``hdlang.DIMENSIONS``, 0.022.
UNKNOWN = 0.07
#: Pages with two equal labels on which profiles are fitted, about; more are thinned out by the hash of their key.
FITTED_PAGES = 20_000


def code(label: Column) -> Column:
    """Language of a label: the part before ``-`` or ``_``, lower case; null for an empty or null label."""
    part = F.lower(F.trim(F.element_at(F.split(label, "[-_]"), 1)))
    return F.when(part != "", part)


def profiles(table: DataFrame, common_words: DataFrame, fitted_pages: int = FITTED_PAGES) -> hdlang.Profiles:
    """Prototypes of the languages of ``common_words``, bundled from about ``fitted_pages`` pages whose two labels agree and from the common words.

    Trigrams are counted where the text is; what comes to the driver is one count for each language and trigram of a fixed alphabet.
    Wrong labels that agree are outvoted by the bundle.
    """
    words = common_words.select("lang", "word").where(F.col("lang").isNotNull() & F.col("word").isNotNull()).distinct().toPandas()
    langs = sorted(set(words["lang"]))
    both = table.withColumns({c: F.lit(None).cast("string") for c in ("text_language", "html_lang") if c not in table.columns})
    lang = code(F.col("text_language"))
    agreed = both.where((lang == code(F.col("html_lang"))) & lang.isin(langs))
    share = min(1.0, fitted_pages / max(agreed.count(), 1))
    if share < 1:
        agreed = agreed.where(F.pmod(F.xxhash64(*pages.KEY), F.lit(1 << 20)) < int(share * (1 << 20)))
    labelled = pages.with_text(agreed).select(code(F.col("text_language")).alias("lang"), "extracted_text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["extracted_text"]:
                total.setdefault(lang, np.zeros(hdlang.CELLS, np.int64))
                total[lang] += np.bincount(hdlang.cells("\n".join(texts)), minlength=hdlang.CELLS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "cell": at.astype(np.int32), "n": n[at]})

    got = labelled.mapInPandas(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for lang in langs:
        own = np.bincount(hdlang.cells(" ".join(words.loc[words["lang"] == lang, "word"])), minlength=hdlang.CELLS).astype(np.float64)
        sub = got[got["lang"] == lang]
        seen = np.bincount(sub["cell"], weights=sub["n"], minlength=hdlang.CELLS)
        counts[lang] = own / max(own.sum(), 1) * 200 + seen
    return hdlang.train(counts)


def stretches(no: np.ndarray, kind: np.ndarray, words: np.ndarray, body: np.ndarray, cosines: np.ndarray, langs: tuple[str, ...]) -> list[tuple[int, int, str, float, int]]:
    """``(first line, last line, language, confidence, words)`` of a page's lines, numbered from 1, neighbours of one language joined.

    Paragraphs of the body get languages of their own: a paragraph takes the page's language unless another one is nearer by ``MARGIN``. A page
    without paragraphs is one stretch, by its body or, without one, by all its lines. A stretch that is near to no language is ``und``.
    Confidence is the lead over the next language, by the sum of both cosines, from 0 to 1.
    """
    if not len(no) or not langs:
        return []
    at = np.flatnonzero(body & (kind == layout.CODE["prose"]) & (words >= PARAGRAPH_WORDS))
    alone = not len(at)
    if alone:
        at = np.flatnonzero(body) if body.any() else np.arange(len(no))
    cos, size = cosines[at].astype(float), words[at].astype(float)
    if alone:
        weight = np.sqrt(size)
        cos, size, span = (weight @ cos / max(weight.sum(), 1e-9))[None, :], np.array([size.sum()]), [(int(no[at[0]]) + 1, int(no[at[-1]]) + 1)]
    else:
        span = [(int(n) + 1, int(n) + 1) for n in no[at]]
    main = int(np.argmax(size @ cos))
    out: list[tuple[int, int, str, float, int]] = []
    for (first, last), c, w in zip(span, cos, size, strict=True):
        best = int(np.argmax(c))
        k = best if c[best] - c[main] > MARGIN else main
        rest = np.delete(c, k).max() if len(c) > 1 else 0.0
        sure = float(np.clip((c[k] - rest) / max(abs(c[k]) + abs(rest), 1e-9), 0.0, 1.0))
        lang = langs[k] if c[k] >= UNKNOWN else "und"
        if out and out[-1][2] == lang:
            f, _, _, s, n = out[-1]
            out[-1] = (f, last, lang, (s * n + sure * w) / (n + w), n + int(w))
        else:
            out.append((first, last, lang, sure, int(w)))
    return out


def prose() -> Column:
    """Whether a labelled page is running prose: it has a body that is neither residue nor mostly lists, tables or junk."""
    return (F.size("residue") == 0) & (F.col("body_words") > 0) & (2 * F.col("odd_words") <= F.col("body_words"))


def segments(labelled: DataFrame) -> DataFrame:
    """Page key, ``from_line``, ``to_line``, ``lang``, ``confidence``, ``words`` of every stretch of every page with text, and whether the page is running prose."""
    return labelled.select(*pages.KEY, F.explode("segments").alias("s"), prose().alias("prose")).select(*pages.KEY, "s.*", "prose").distinct()


def found(labelled: DataFrame) -> DataFrame:
    """Page key and ``lang``: languages of pages of running prose whose label is missing, empty or another, or that hold several languages.
    Stretches in none of the known languages name none."""
    langs = F.array_distinct(F.filter(F.col("segments.lang"), lambda x: x != "und"))
    own = labelled.where(prose()).select(*pages.KEY, code(F.col("text_language")).alias("label"), langs.alias("langs"))
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return own.where(wrong).select(*pages.KEY, F.explode("langs").alias("lang")).distinct()
