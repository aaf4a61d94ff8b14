"""Lines and blocks of lines that repeat across the documents of one source, by suffix arrays over line identifiers.

Texts are read once into a narrow table of line hashes. The array's first bucketing, by source and first identifier, counts documents; a bucket
of fewer than ``least`` documents holds no block, so documents are cut into runs of the other lines, which loses none. Every run gives its
suffixes of at most ``LONGEST`` lines. Equal suffixes are added up before they travel; what a document has twice is taken off again (see
:func:`suffixes`), so weights count documents. The array is sorted by range over all tasks, whatever source or line is hot, and one pass
over the neighbours' common prefixes in each piece gives every block; blocks that cross pieces are added up by their lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import pages
from . import pagelines as pl

#: Documents that a block must stand in. Lines of a block at most; a longer one is found as all of its parts of that length.
LEAST, LONGEST = 8, 32


def line_ids(table: DataFrame) -> DataFrame:
    """``s, a, b, u, ids`` of pages with text and domain: hashes of source, page and text, and of each tidied line, 0 for an empty one."""
    rows = pages.identified(pages.with_text(table).where(F.col("registrable_domain").isNotNull()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            ends = [0]
            for text in batch.column("extracted_text").to_pylist():
                ids += [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) if x else 0 for x in map(pl.tidy, text.split("\n"))]
                ends.append(len(ids))
            flat = pa.array(ids, pa.uint64()).view(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("s", *pages.ID)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["s", *pages.ID, "ids"])

    return rows.select(F.xxhash64("registrable_domain").alias("s"), *pages.ID, "extracted_text").mapInArrow(read, "s long, a long, b long, u long, ids array<long>")


def _each(ids: DataFrame) -> DataFrame:
    """One row for each non-empty line: its number in the page (from 0) and its place among the non-empty ones."""
    full = F.filter(F.transform("ids", lambda x, i: F.struct(i.alias("no"), x.alias("id"))), lambda x: x["id"] != 0)
    return ids.select("s", *pages.ID, F.posexplode(full).alias("k", "x")).select("s", *pages.ID, "k", "x.no", "x.id")


def buckets(ids: DataFrame, least: int = LEAST) -> DataFrame:
    """``s, id, a, b, u, no``: first identifiers with ``least`` or more documents, and a page and line where each stands."""
    once = _each(ids).groupBy("s", "id", "a", "b").agg(F.min(F.struct("u", "no")).alias("at"))
    held = once.groupBy("s", "id").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("a", "b", "at")).alias("w")).where(F.col("docs") >= least)
    return held.select("s", "id", "w.a", "w.b", "w.at.u", "w.at.no")


def suffixes(documents: list[list[list[int]]]) -> dict[tuple[int, ...], int]:
    """Weights of the suffixes of all documents' runs, so that the weights of all strings that begin with a block add up to its documents.

    A document's own suffixes are sorted; each common prefix of two neighbours is counted off once, as of ``m`` suffixes that begin with a block
    ``m - 1`` pairs of neighbours share it.
    """
    out: dict[tuple[int, ...], int] = {}
    for runs in documents:
        own = sorted(tuple(run[i : i + LONGEST]) for run in runs for i in range(len(run)))
        last: tuple[int, ...] = ()
        for x in own:
            out[x] = out.get(x, 0) + 1
            common = 0
            for p, q in zip(last, x, strict=False):
                if p != q:
                    break
                common += 1
            if common:
                out[x[:common]] = out.get(x[:common], 0) - 1
            last = x
    return {k: v for k, v in out.items() if v}


def runs(ids: DataFrame, often: DataFrame) -> DataFrame:
    """``s, a, b, seq``: the lines of each page that are in ``often``, with their places among its non-empty lines. A key of two texts has both, one after the other.

    A hot line gathers its pages in the join, which adaptive execution splits.
    """
    seen = _each(ids).select("s", *pages.ID, "k", "id").join(often.select("s", "id"), ["s", "id"])
    return seen.groupBy("s", "a", "b").agg(F.collect_set(F.struct("u", "k", "id")).alias("seq"))


def weighted(runs_: DataFrame) -> DataFrame:
    """``s, ids, n``: :func:`suffixes` of all pages, equal ones of a source added up."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for s, group in batch.groupby("s")["seq"]:
                documents = []
                for seq in group:
                    own: list[list[int]] = []
                    before = None
                    for x in sorted((r["u"], r["k"], r["id"]) for r in seq):
                        if before is None or x[0] != before[0] or x[1] != before[1] + 1:
                            own.append([])
                        own[-1].append(x[2])
                        before = x
                    documents.append(own)
                out += [(s, list(k), v) for k, v in suffixes(documents).items()]
            yield pd.DataFrame(out, columns=["s", "ids", "n"])

    return runs_.select("s", "seq").mapInPandas(cut, "s long, ids array<long>, n long").groupBy("s", "ids").agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def blocks(weighted_: DataFrame, least: int = LEAST) -> DataFrame:
    """``s, block, docs``: blocks of lines that stand in ``least`` or more documents; of those with the same documents the longest, and some shorter ones."""
    array = weighted_.repartitionByRange("s", "ids").sortWithinPartitions("s", "ids")
    parts = array.mapInPandas(_scan(least), "s long, block array<long>, n long")
    return parts.groupBy("s", "block").agg(F.sum("n").alias("docs")).where(F.col("docs") >= least)


def _scan(least: int):
    """Common-prefix intervals of a piece of the array. An interval that touches an end of the piece may go on in the next one and is given with what is seen of it here."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, list[int], int]] = []
        first: tuple[int, list[int]] | None = None
        begun: list[int] = []  # weights of the prefixes of the piece's first string
        shared = 0  # common prefix of the first string and the current one
        source, last = None, []
        stack: list[list[int]] = []  # [length, weight, whether it began with the piece]

        def close(to: int, end: bool = False) -> None:
            while stack and stack[-1][0] > to:
                size, n, whole = stack.pop()
                below = stack[-1][0] if stack else 0
                if not whole and end:
                    out.extend((source, last[:k], n) for k in range(max(below, to) + 1, size + 1))
                elif not whole and n >= least:
                    out.append((source, last[:size], n))
                if below >= to and stack:
                    stack[-1][1] += n
                elif to:
                    stack.append([to, n, whole])

        for b in batches:
            for s, ids, n in zip(b["s"].tolist(), b["ids"].tolist(), b["n"].tolist(), strict=True):
                ids = [int(x) for x in ids]
                common = 0
                if s == source:
                    for x, y in zip(last, ids, strict=False):
                        if x != y:
                            break
                        common += 1
                if first is None:
                    first, begun, shared = (s, ids), [0] * len(ids), len(ids)
                elif shared:
                    shared = min(shared, common)
                for k in range(shared):
                    begun[k] += n
                close(common)
                source, last = s, ids
                if stack and stack[-1][0] == len(ids):
                    stack[-1][1] += n
                else:
                    stack.append([len(ids), n, int(len(ids) <= shared)])
            yield pd.DataFrame(out, columns=["s", "block", "n"])
            out.clear()
        close(0, True)
        if first is not None:
            out.extend((first[0], first[1][: k + 1], n) for k, n in enumerate(begun))
        yield pd.DataFrame(out, columns=["s", "block", "n"])

    return scan


def repeated(ids: DataFrame, least: int = LEAST) -> DataFrame:
    """``s, id`` and a place (a, b, u, no) of every line of every block."""
    often = materialise(buckets(ids, least), "buckets")
    lines = blocks(weighted(runs(ids, often)), least).select("s", F.explode("block").alias("id")).distinct()
    return often.join(lines, ["s", "id"])


def found(table: DataFrame, least: int = LEAST) -> DataFrame:
    """``registrable_domain, line_text`` of the lines of all repeated blocks, single lines included. The text of each is taken from one page that holds it."""
    at = materialise(repeated(materialise(line_ids(table), "line-ids"), least).groupBy(*pages.ID).agg(F.collect_set("no").alias("numbers")), "places")
    text = pages.identified(pages.with_text(table)).select("registrable_domain", *pages.ID, "extracted_text").join(at, pages.ID)
    line = F.explode(F.transform("numbers", lambda i: F.get(F.split("extracted_text", "\n"), i)))
    return text.select("registrable_domain", line.alias("line")).select("registrable_domain", pages.tidy_line(F.col("line")).alias("line_text")).distinct()


def cleaned(table: DataFrame, least: int = LEAST) -> DataFrame:
    """Page key, ``text`` without the lines of repeated blocks, and ``removed_lines``, for every page with text, delivered once.

    A page of which nothing is left has the empty text. Pages without domain keep all lines.
    """
    ids = materialise(line_ids(table), "line-ids")
    gone = _each(ids).join(repeated(ids, least).select("s", "id"), ["s", "id"]).groupBy(*pages.ID).agg(F.collect_set("no").alias("gone"))
    rows = pages.identified(pages.with_text(table)).select(*pages.KEY, *pages.ID, "extracted_text").dropDuplicates(pages.ID).join(gone, pages.ID, "left")
    drop = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.filter(F.split("extracted_text", "\n"), lambda x, i: ~F.array_contains(drop, i))
    return rows.select(*pages.KEY, F.array_join(kept, "\n").alias("text"), F.size(drop).alias("removed_lines"))
