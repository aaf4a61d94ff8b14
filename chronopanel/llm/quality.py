"""Per-page writing statistics and their robust Mahalanobis distance from prose of the same language.

The reference of a language is a mean and covariance of its pages that outliers don't move: starting from medians and median deviations, the
half of the pages that lies nearest is taken and its mean and covariance give new distances (concentration steps), the covariance is
scaled so that the median distance is that of a normal distribution, and all pages within ``NEAR`` are taken once more. Moments are summed where the pages are;
one small matrix for each language comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import pages

STATISTICS = (
    "log_words", "mean_word_length", "word_length_spread", "symbol_ratio", "digit_ratio", "capital_ratio", "commas_per_word", "end_mark_share", "common_word_share", "log_words_in_line",
)
#: Quantiles of chi-square with 10 degrees of freedom: 0.5 and 0.975.
MEDIAN, NEAR = 9.342, 20.483
#: Squared distance beyond which a page isn't prose, far in the tail (chi-square below 1e-12) because prose has heavier tails than a normal distribution:
#: at sf0.1 prose reaches 47 and pages of lists, tables or junk begin at 130.
CUTOFF = 80.0
#: Concentration steps; pages that the moments of all languages together count for in each language's own.
STEPS, POOLED = 2, 40
#: Least standard deviations, so that a statistic that hardly varies in prose doesn't decide alone.
FLOOR = np.array([0.6, 0.4, 0.3, 0.015, 0.02, 0.02, 0.03, 0.08, 0.05, 0.3])
K = len(STATISTICS)
_KEEP = f"{pages.KEY_SCHEMA}, lang string, residue boolean, odd_share double, stats array<double>"


def page_statistics(labelled: DataFrame) -> DataFrame:
    """One row for each page with text: language, whether it is residue, share of body words in lists, tables and junk, and the statistics over all of its body.

    ``stats`` is null for a page without body. Shares of words: in lines that end in an end mark, among the language's common words; a word's line has
    ``exp(log_words_in_line)`` words on average.
    """
    w, letters, digits, symbols, capitals, commas, common, ended, line, squares = (F.col("sums")[i] for i in range(len(pages.SUMS)))
    solid = F.greatest(letters + digits + symbols, F.lit(1.0))
    mean = solid / w
    spread = F.sqrt(F.greatest(squares / w - mean * mean, F.lit(0.0)))
    stats = F.array(F.log1p(w), mean, spread, symbols / solid, digits / solid, capitals / F.greatest(letters, F.lit(1.0)), commas / w, ended / w, common / w, F.log(F.greatest(line / w, F.lit(1.0))))
    residue = (F.size("residue") > 0) if "residue" in labelled.columns else F.lit(False)
    share = F.when(F.col("body_words") > 0, F.col("odd_words") / F.col("body_words")).otherwise(1.0)
    return labelled.select(*pages.KEY, "lang", residue.alias("residue"), share.alias("odd_share"), F.when(w > 0, stats).alias("stats")).distinct()


Reference = dict[str, tuple[np.ndarray, np.ndarray]]


def _squared(lang: pd.Series, x: np.ndarray, ref: Reference) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances, and each statistic's contribution to them."""
    parts = np.zeros_like(x)
    for name in lang.unique():
        at = (lang == name).to_numpy()
        mean, inverse = ref.get(name) or ref[""]
        z = x[at] - mean
        parts[at] = z * (z @ inverse)
    return parts.sum(axis=1), parts


def _moments(stats: DataFrame, ref: Reference | None, limit: dict[str, float]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Number, sums and products of the pages of each language within ``limit`` of ``ref``; under ``''`` those of all."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            x = np.array(b["stats"].tolist(), dtype=float)
            if ref:
                d, _ = _squared(b["lang"], x, ref)
                near = d <= b["lang"].map(limit).fillna(limit[""]).to_numpy()
                b, x = b[near], x[near]
            for lang in b["lang"].unique():
                own = x[(b["lang"] == lang).to_numpy()]
                flat = np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
                total[lang] = total.get(lang, 0.0) + flat
        yield pd.DataFrame({"lang": list(total), "m": [v.tolist() for v in total.values()]})

    rows = stats.select("lang", "stats").mapInPandas(add, "lang string, m array<double>").select("lang", F.posexplode("m")).groupBy("lang", "pos").agg(F.sum("col").alias("v")).collect()
    flat: dict[str, np.ndarray] = {}
    for r in rows:
        flat.setdefault(r["lang"], np.zeros(1 + K + K * K))[r["pos"]] = r["v"]
    flat[""] = sum(flat.values(), np.zeros(1 + K + K * K))
    return {k: (float(v[0]), v[1 : 1 + K], v[1 + K :].reshape(K, K)) for k, v in flat.items()}


def _reference(moments: dict[str, tuple[float, np.ndarray, np.ndarray]], scale: dict[str, float] | None = None) -> Reference:
    """Mean and inverse covariance for each language; those of all together count as ``POOLED`` pages of each, so a rare language is close to them."""
    n, s, p = moments[""]
    if n < 1:
        return {}
    out: Reference = {}
    for lang, (m, t, q) in moments.items():
        weight = POOLED / n if lang else 0.0
        size, total, products = m + weight * n, t + weight * s, q + weight * p
        mean = total / size
        cov = (products / size - np.outer(mean, mean)) * (scale or {}).get(lang, 1.0)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        grow = np.maximum(sd, FLOOR) / sd
        out[lang] = (mean, np.linalg.inv(cov * np.outer(grow, grow) + np.diag(FLOOR**2) * 0.1))
    return out


def _quantile(stats: DataFrame, ref: Reference) -> dict[str, float]:
    """Median squared distance of each language's pages, and of all under ``''``."""
    per = distances(stats, ref).groupBy("lang").agg(F.percentile_approx("distance", 0.5, 1000).alias("q"), F.count(F.lit(1)).alias("n")).collect()
    out = {r["lang"]: float(r["q"]) for r in per}
    out[""] = float(np.median(list(out.values()))) if out else 0.0
    return out


def reference(stats: DataFrame) -> Reference:
    """Robust mean and inverse covariance of the statistics for each language, and of all under ``''``; empty without any page that has a body."""
    usable = stats.where(F.col("stats").isNotNull() & ~F.col("residue"))
    s = [F.col("stats")[i] for i in range(K)]
    mid = {r["lang"]: r for r in usable.groupBy("lang").agg(*[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{i}") for i, x in enumerate(s)]).collect()}
    if not mid:
        return {}
    ref: Reference = {}
    for lang, r in mid.items():
        q = np.array([r[f"q{i}"] for i in range(K)])
        ref[lang] = (q[:, 1], np.diag(1 / np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOOR) ** 2))
    ref[""] = (np.mean([m for m, _ in ref.values()], axis=0), np.mean([v for _, v in ref.values()], axis=0))
    for _ in range(STEPS):
        ref = _reference(_moments(usable, ref, _quantile(usable, ref)))
    middle = _quantile(usable, ref)
    limit = {k: v * NEAR / MEDIAN for k, v in middle.items()}
    return _reference(_moments(usable, ref, limit))


def distances(stats: DataFrame, ref: Reference) -> DataFrame:
    """``stats`` with ``distance`` (squared) and ``contributions`` (one for each statistic; they add up to the distance); null without body."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d, parts = pd.Series(np.nan, index=b.index), pd.Series([None] * len(b), index=b.index, dtype="object")
            have = b["stats"].notna().to_numpy() if ref else np.zeros(len(b), bool)
            if have.any():
                own = b[have]
                total, each = _squared(own["lang"], np.array(own["stats"].tolist(), dtype=float), ref)
                d[have] = total
                parts[have] = pd.Series(list(each), index=own.index)
            yield b.assign(distance=d.astype(object).where(d.notna(), None), contributions=parts)

    return stats.mapInPandas(score, f"{_KEEP}, distance double, contributions array<double>")


def assessed(labelled: DataFrame) -> DataFrame:
    """:func:`distances` of every page with text against references from all pages. Statistics are written once and read again."""
    stats = materialise(page_statistics(labelled), "statistics")
    return distances(stats, reference(stats))


def found(assessed_pages: DataFrame) -> DataFrame:
    """Page keys that aren't prose: far from the prose of their language, or without body. Residue is left out."""
    return assessed_pages.where(~F.col("residue") & (F.col("stats").isNull() | (F.col("distance") > CUTOFF))).select(*pages.KEY).distinct()
