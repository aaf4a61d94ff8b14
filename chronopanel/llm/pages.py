"""Pages as Spark tables: their lines, how often a site repeats them, and the labels of every page.

Three steps feed all page operators. :func:`scan` reads each text once, in Arrow batches, and keeps a narrow row for each page: kind, words,
length and hash of every line, and what an operator asks for (residue, statistics, languages). :func:`with_repeats` counts in how many texts of its
site each line stands; only hashes travel. :func:`labelled` fits the costs of :mod:`layout` on counts of all lines and cuts every page.

The page key is (firm_id, relative_timepoint, original_archived_url). Rows without URL aren't pages; pages without text have no lines. A page that
is delivered twice is labelled twice and yields the same rows, which are made distinct when they are small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import hdlang, layout, residue
from . import pagelines as pl

KEY = ["firm_id", "relative_timepoint", "original_archived_url"]
KEY_SCHEMA = "firm_id string, relative_timepoint string, original_archived_url string"
ID = ["a", "b", "u"]
_NEEDED = [*KEY, "registrable_domain", "document_title", "h1_text", "extracted_text"]
#: Characters of text that are looked at together in a worker.
CHUNK = 300_000


def tidy_line(line: Column) -> Column:
    """No-break spaces and tabs become spaces, runs of spaces one space, ends are trimmed."""
    plain = F.translate(line, "\t\u00a0", "  ")
    return F.trim(F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain))


def page_id() -> Column:
    """Sixteen bytes that stand for the page key; nulls are told from empty strings."""
    parts = [F.coalesce(F.col(c), F.lit("\u0001")) for c in KEY]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7), *reversed(parts)).alias("b"))


def with_text(pages: DataFrame, or_title: bool = False) -> DataFrame:
    """Rows that are pages with text, or with a title if ``or_title``. Other columns than the needed ones may be absent or present; the needed are null if absent."""
    have = set(pages.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in _NEEDED]
    rest = [c for c in ("meta_description", "text_language", "html_lang") if c in have]
    some = lambda c: (F.length(c) > 0) & (F.trim(F.translate(c, "\n\t\u00a0", "")) != "")
    filled = some("extracted_text") | some("document_title") if or_title else some("extracted_text")
    return pages.select(*cols, *rest).where(F.col("original_archived_url").isNotNull() & filled)


def identified(pages: DataFrame) -> DataFrame:
    """``pages`` with the hashes of key (a, b) and text (u) that name a page and its text."""
    return pages.withColumn("_p", page_id()).select("*", "_p.a", "_p.b", F.xxhash64("extracted_text").alias("u")).drop("_p")


#: Sums over a line's characters and words, in the order of the columns of ``stats``.
SUMS = ("words", "letters", "digits", "symbols", "capitals", "commas", "common", "ended", "line", "squares")
_KIND = np.full(0x110000, 3, dtype=np.uint8)  # 0 letter, 1 digit, 2 space, 3 other, 4 capital


def _fill() -> None:
    for c in range(0x3000):
        x = chr(c)
        _KIND[c] = 4 if x.isupper() else 0 if x.isalpha() else 1 if x.isdigit() else 2 if x.isspace() else 3
    _KIND[0x3400:0x10000] = 0
    _KIND[0xE000:0xF900] = 3
    _KIND[0x20000:0x32000] = 0


_fill()


def line_sums(texts: list[str], words: list[int], common: list[int]) -> np.ndarray:
    """One row of ``SUMS`` for each text. ``line``: words times words; ``squares``: squared lengths of words."""
    if not texts:
        return np.zeros((0, len(SUMS)))
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", dtype=np.uint32)
    kind = _KIND[code]
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
    count = lambda x: np.add.reduceat(x.view(np.int8), begin, dtype=np.int64)
    gap = np.flatnonzero(kind == 2)
    size = np.diff(gap, prepend=-1) - 1
    squares = np.bincount(np.searchsorted(begin, gap, side="right") - 1, weights=size.astype(float) ** 2, minlength=len(texts))
    n = np.array(words, dtype=float)
    ended = n * np.array([pl.ends_sentence(t) for t in texts])
    capitals = count(kind == 4)
    return np.stack([n, count(kind == 0) + capitals, count(kind == 1), count(kind == 3), capitals, count(code == 44), np.array(common, dtype=float), ended, n * n, squares], axis=1)


def _binary(flat: np.ndarray, ends: list[int]) -> pa.Array:
    """Slices of ``flat`` that end at ``ends`` as binary values."""
    at = [0, *ends]
    return pa.array([flat[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())


def _reader(names: list[str], schema: str, model: hdlang.Profiles | None, lists: dict[str, tuple[int, ...]] | None, marks: bool, languages: bool) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """The work of :func:`scan` on a batch of pages."""
    stats = lists is not None
    known = [frozenset(w for w, of in (lists or {}).items() if k in of).__contains__ for k in range(len(model.langs) if model else 0)] or [frozenset().__contains__]
    plain = np.array([k in ("prose", "head", "list", "table", "junk", "notice", "filler", "script") for k in pl.KINDS])

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, titles, heads = (batch.column(c).to_pylist() for c in ("extracted_text", "document_title", "h1_text"))
        lines: list[pl.Line] = []
        own: list[bool] = []
        ends: list[int] = []
        for text, title, head in zip(texts, titles, heads, strict=True):
            if text:
                got = [pl.classify(x) for x in text.split("\n")]
                lines += got
                if title or head:
                    mine = layout.own_titles((title, head))
                    own += [layout.is_own(x, mine) for x in got]
                else:
                    own += [False] * len(got)
            ends.append(len(lines))
        kind = np.array([pl.CODE[x.kind] for x in lines], dtype=np.int8)
        words = np.array([x.words for x in lines], dtype=np.int32)
        hashes = np.array([xxhash.xxh64_intdigest(x.text.encode("utf-8", "surrogatepass")) if x.kind else 0 for x in lines], dtype=np.uint64).view(np.int64)
        out = [batch.column(c) for c in names]
        size = np.array([layout.size_class(x.text) for x in lines], dtype=np.int8)
        out += [_binary(kind, ends), _binary(words, ends), _binary(size, ends), _binary(np.array(own, dtype=bool), ends)]
        out.append(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(hashes)))
        if marks:
            out.append(pa.array([[f"{r.kind}\x1f{r.piece}" for r in residue.marks(t, title)] for t, title in zip(texts, titles, strict=True)], pa.list_(pa.string())))
            odd = np.isin(kind, [pl.CODE[k] for k in ("notice", "filler", "script")])
            out.append(pa.array([[f"{k - i}\x1f{lines[k].kind}\x1f{lines[k].text}" for k in (np.flatnonzero(odd[i:j]) + i).tolist()] for i, j in zip([0, *ends], ends, strict=False)], pa.list_(pa.string())))
        if model is not None:
            of = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
            dots, squares = model.sums([x.text for x in lines], languages)
            use = plain[kind] & (kind > 0)
            none = np.bincount(of, weights=use, minlength=len(ends))[of] == 0
            weight = (use | none)[:, None]
            per = np.zeros((len(ends), len(model.langs)))
            np.add.at(per, of, dots * weight)
            lang = per.argmax(axis=1) if len(model.langs) else np.full(len(ends), -1)
            out.append(pa.array(lang.astype(np.int32)))
            if stats:
                common = [sum(map(known[page], x.text.lower().split(" "))) for x, page in zip(lines, lang[of].tolist(), strict=True)]
                out.append(_binary(line_sums([x.text for x in lines], words.tolist(), common).astype(np.float32), ends))
            if languages:
                out.append(_binary((dots / np.sqrt(np.maximum(squares, 1.0) * hdlang.DIMENSIONS)[:, None]).astype(np.float32), ends))
        return pa.RecordBatch.from_arrays(out, names=[x.split(" ")[0] for x in schema.split(", ")])

    return chunk


def scan(table: DataFrame, model: hdlang.Profiles | None = None, common_words: DataFrame | None = None, marks: bool = False, languages: bool = False, or_title: bool = False) -> DataFrame:
    """One narrow row for each page with text (or title, if ``or_title``): key, hashes, and for each line, empty ones included, its kind, words, length class and hash.

    ``marks``: placeholders and default titles, and the lines that may be filler or notices. ``model``: the page's language ``lang`` by all lines that
    aren't chrome of themselves; with ``common_words`` (lang, word; a list of a fixed size) also sums for statistics; with ``languages`` cosines of each line.
    """
    base = identified(with_text(table, or_title))
    names = [*KEY, *ID, "d", *(["text_language"] if languages else [])]
    cols = [*KEY, *ID, F.when(F.col("registrable_domain").isNotNull(), F.xxhash64("registrable_domain")).alias("d")]
    if languages:
        cols.append(F.col("text_language") if "text_language" in base.columns else F.lit(None).cast("string").alias("text_language"))
    lists: dict[str, tuple[int, ...]] = {}
    if common_words is not None and model is not None:
        rows = common_words.select("lang", "word").where(F.col("lang").isNotNull() & F.col("word").isNotNull()).distinct().toPandas()
        lists = {w: tuple(model.langs.index(x) for x in g if x in model.langs) for w, g in rows.groupby("word")["lang"]}
    stats = common_words is not None and model is not None
    schema = f"{KEY_SCHEMA}, a long, b long, u long, d long" + (", text_language string" if languages else "") + ", kind binary, words binary, size binary, own binary, h array<long>"
    schema += (", pieces array<string>, odd array<string>" if marks else "") + (", lang int" if model else "") + (", stats binary" if stats else "") + (", cosines binary" if languages else "")
    chunk = _reader(names, schema, model, lists if stats else None, marks, languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum([len(x or "") for x in batch.column("extracted_text").to_pylist()]) // CHUNK
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                yield chunk(batch.slice(int(at[0]), len(at)))

    return base.select(*cols, "document_title", "h1_text", "extracted_text").mapInArrow(run, schema)


def with_repeats(lines: DataFrame) -> DataFrame:
    """``lines`` with ``repeats``: number of each line (from 0) that stands in several texts of its domain, and its repetition level, see :mod:`layout`.

    Copies of a page under two addresses are one text. Only hashes travel. Counting aggregates before its shuffle; the join back is on
    (domain, line), where adaptive execution splits what a hot line gathers.
    """
    own = lines.where(F.col("d").isNotNull())
    narrow = own.select(*ID, "d", F.posexplode("h").alias("no", "h")).where(F.col("h") != 0)
    site = own.select("d", "u").distinct().groupBy("d").agg(F.count(F.lit(1)).alias("texts"))
    often = narrow.select("d", "h", "u").distinct().groupBy("d", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).join(site, "d")
    level = F.when(F.col("n") >= layout.OFTEN, 3).when(F.col("n") >= layout.SHARE * F.col("texts"), 2).otherwise(1)
    seen = narrow.join(often.select("d", "h", level.alias("level")), ["d", "h"]).groupBy(*ID).agg(F.collect_set(F.struct("no", "level")).alias("repeats"))
    return lines.drop("h", "d").join(seen, ID, "left")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values (number, level) of the column ``repeats``; a null list is empty."""
    of, no, n = [], [], []
    for i, x in enumerate(column.to_pylist()):
        for y in x or ():
            of.append(i)
            no.append(y["no"])
            n.append(y["level"])
    return np.array(of, dtype=np.int64), np.array([no, n], dtype=np.int64).reshape(2, -1)


class _Flat:
    """Lines of a batch, flat: ``of`` page, ``no`` number in the page (from 0), and positions of non-empty lines."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        take = lambda c, t: np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=t)
        kind = take("kind", np.int8)
        count = np.array([len(x) for x in batch.column("kind").to_pylist()], dtype=np.int64)
        begin = np.concatenate(([0], np.cumsum(count)))[:-1] if len(count) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(count)), count)
        no = np.arange(len(kind)) - np.repeat(begin, count)
        level = np.zeros(len(kind), dtype=np.int64)
        at, (number, n) = _lists(batch.column("repeats"))
        if len(at):
            level[begin[at] + number] = n
        self.at = np.flatnonzero(kind > 0)
        self.pages, self.of, self.no = len(count), of[self.at], no[self.at]
        self.kind, self.words = kind[self.at].astype(np.int64), take("words", np.int32)[self.at].astype(np.int64)
        self.lines = layout.describe(self.dense(), self.no, self.kind, self.words, take("size", np.int8)[self.at].astype(np.int64), take("own", bool)[self.at], level[self.at])
        self.take = take

    def dense(self) -> np.ndarray:
        """Pages counted without those that have no line."""
        return np.unique(self.of, return_inverse=True)[1] if len(self.of) else self.of


def fitted(lined: DataFrame) -> layout.Costs:
    """Costs of :mod:`layout` from counts of all lines. One row for each combination of features that occurs comes to the driver, at most ``layout.SHAPE`` and twelve."""
    cells = int(np.prod(layout.SHAPE))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells + 12, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.concatenate(layout.tally(_Flat(batch).lines))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    rows = lined.select("kind", "words", "size", "own", "repeats").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(cells + 12)
    for r in rows:
        total[r["cell"]] = r["n"]
    return layout.fit(total[:cells], total[cells:])


def labelled(lined: DataFrame, costs: layout.Costs, langs: tuple[str, ...] = ()) -> DataFrame:
    """Pages with ``chrome`` (numbers of chrome lines from 1), ``body_words``, ``odd_words`` (those in lists, tables and junk), ``notice_only``, and what the scan asked for:
    ``residue`` (kind and piece), ``lang``, ``sums`` of statistics over the body, ``segments`` of one language."""
    from .language import stretches

    have = set(lined.columns)
    marks, stats, spoken = "pieces" in have, "stats" in have, "cosines" in have
    keep = [*KEY, *ID, *(["text_language"] if spoken else [])]
    schema = f"{KEY_SCHEMA}, a long, b long, u long" + (", text_language string" if spoken else "") + ", chrome array<int>, body_words long, odd_words long, notice_only boolean"
    schema += (", residue array<struct<kind: string, piece: string>>" if marks else "") + (", lang string" if "lang" in have else "") + (", sums array<double>" if stats else "")
    schema += ", segments array<struct<from_line: int, to_line: int, lang: string, confidence: double, words: int>>" if spoken else ""
    names = [x for x in ("chrome", "body_words", "odd_words", "notice_only", *(["residue"] if marks else []), *(["lang"] if "lang" in have else []), *(["sums"] if stats else []), *(["segments"] if spoken else []))]
    piece = pa.struct([("kind", pa.string()), ("piece", pa.string())])
    segment = pa.struct([("from_line", pa.int32()), ("to_line", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _Flat(batch)
            chrome = layout.cut(x.lines, costs)
            total, odd, only = layout.summary(x.of, x.pages, x.kind, x.words, chrome)
            ends = np.cumsum(np.bincount(x.of[chrome], minlength=x.pages))
            out = [batch.column(c) for c in keep]
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array((x.no[chrome] + 1).astype(np.int32))))
            out += [pa.array(total.astype(np.int64)), pa.array(odd.astype(np.int64)), pa.array(only)]
            if marks:
                begin = np.concatenate(([0], np.cumsum([len(k) for k in batch.column("kind").to_pylist()])))
                position = np.ones(begin[-1], dtype=bool)
                position[x.at] = chrome
                rows = []
                for i, (got, lines, alone) in enumerate(zip(batch.column("pieces").to_pylist(), batch.column("odd").to_pylist(), only.tolist(), strict=True)):
                    mine = [dict(zip(("kind", "piece"), p.split("\x1f", 1), strict=True)) for p in got]
                    for line in lines:
                        no, kind, text = line.split("\x1f", 2)
                        if kind == "filler" or alone and not position[begin[i] + int(no)]:
                            mine.append({"kind": "filler" if kind == "filler" else "notice", "piece": text})
                    rows.append(mine)
                out.append(pa.array(rows, pa.list_(piece)))
            if "lang" in have:
                out.append(pa.array([langs[k] if 0 <= k < len(langs) else "und" for k in batch.column("lang").to_pylist()], pa.string()))
            if stats:
                flat = x.take("stats", np.float32).reshape(-1, len(SUMS))[x.at]
                sums = np.zeros((x.pages, len(SUMS)))
                np.add.at(sums, x.of[~chrome], flat[~chrome].astype(float))
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(x.pages + 1, dtype=np.int32) * len(SUMS)), pa.array(sums.ravel())))
            if spoken:
                cosines = x.take("cosines", np.float32).reshape(-1, len(langs))[x.at] if langs else np.zeros((len(x.at), 0))
                first, last = np.searchsorted(x.of, np.arange(x.pages)), np.searchsorted(x.of, np.arange(x.pages), side="right")
                rows = [stretches(x.no[i:j], x.kind[i:j], x.words[i:j], ~chrome[i:j], cosines[i:j], langs) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                out.append(pa.array([[dict(zip(("from_line", "to_line", "lang", "confidence", "words"), s, strict=True)) for s in r] for r in rows], pa.list_(segment)))
            yield pa.RecordBatch.from_arrays(out, names=[*keep, *names])

    return lined.mapInArrow(run, schema)


def prepared(table: DataFrame, model: hdlang.Profiles | None = None, common_words: DataFrame | None = None, marks: bool = False, languages: bool = False, or_title: bool = False) -> DataFrame:
    """:func:`labelled` pages, all steps in a row: one reading of the texts, two written narrow tables, one small count on the driver. One such table with all options
    feeds every page operator."""
    lines = materialise(scan(table, model, common_words, marks, languages, or_title), "lines")
    lined = materialise(with_repeats(lines), "lined")
    return labelled(lined, fitted(lined), model.langs if model else ())
