"""Long stretches that documents share word for word, by recompression.

A document is a sequence of symbols, at first one for each token (a word with what follows it up to the next word). In every round each run
of one symbol becomes one symbol, and then each pair of neighbours (left, right) with ``left`` in one half and ``right`` in the other half
of all symbols - halves change from round to round - becomes one symbol. A new symbol's name is a hash of what it stands for, so all
documents, wherever they are processed, give equal stretches equal names, up to a few symbols at the stretch's ends. Symbols whose text
would grow beyond ``LONGEST`` characters aren't paired. After the rounds, neighbouring symbols are named together until they span
``ANCHOR`` characters, and of every ``NEIGHBOURS`` such names in a row the least is kept as an anchor. Equal anchors of different documents show
a shared stretch, which is verified and measured on the texts. An anchor that follows the same anchor at the same distance wherever it
stands adds nothing to that one and is dropped, so a passage brings its first anchors only, however long it is.

Why hardly any is missed: the ends of a shared stretch that are parsed differently grow by at most one symbol in a round. With the lengths that
texts have that is about 60 characters on each side; 3,000 random stretches of 500 characters of the test texts had at least four names
in a row in common. It isn't a proof for every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Least shared characters, rounds, longest symbol and anchor in characters, names in a row of which one is kept.
LEAST, ROUNDS, LONGEST, ANCHOR, NEIGHBOURS = 500, 6, 64, 160, 3
#: One in so many places inside a token longer than ``LONGEST`` is a cut, by the hash of the characters around it.
CUT = 16
#: Documents of an anchor that are joined in one piece with all of its documents.
PIECE = 200
_MIX1, _MIX2, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(0x110000, dtype=bool)


def _fill() -> None:
    for c in range(0x20000):
        _WORD[c] = chr(c).isalnum()


_fill()


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


_RANDOM = _mix(np.arange(1, 0x110001, dtype=np.uint64) * _B)
_POWER = np.ones(LONGEST + 1, dtype=np.uint64)
with np.errstate(over="ignore"):
    np.multiply.accumulate(np.full(LONGEST, _B), out=_POWER[1:])


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and start positions of the tokens of all texts one after the other, and where each text begins. A token longer than ``LONGEST`` is cut
    where the characters say so, and pieces that are still longer every ``LONGEST``."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begin = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    n = len(code)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), begin
    word = _WORD[code]
    first = np.concatenate(([True], word[1:] & ~word[:-1]))
    first[begin[:-1][begin[:-1] < n]] = True
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, n))
    long = size > LONGEST
    if long.any():
        inside = np.zeros(n + 1, dtype=np.int8)
        inside[start[long] + 1] = 1
        inside[(start + size)[long]] -= 1
        with np.errstate(over="ignore"):
            near = _mix(_RANDOM[code[1:]] * _MIX2 + _RANDOM[code[:-1]]) % np.uint64(CUT) == 0
        first[1:] |= near & (np.cumsum(inside[:-1], dtype=np.int64)[1:] > 0)
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, n))
    if (size > LONGEST).any():
        pieces = -(-size // LONGEST)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + step * LONGEST
        size = np.diff(np.append(start, n))
    with np.errstate(over="ignore"):
        place = np.arange(n, dtype=np.int64) - np.repeat(start, size)  # inside the token, so below LONGEST
        name = np.add.reduceat(_RANDOM[code] * _POWER[place], start)
    return _mix(name ^ (size.astype(np.uint64) << np.uint64(48))), start, begin


def rounds(name: np.ndarray, start: np.ndarray, begin: np.ndarray, times: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Names and start positions of the symbols after ``times`` rounds of naming runs and pairs. No symbol crosses from a text to the next.

    A run that is longer than ``LONGEST`` stays as it is, so that its name doesn't depend on how long it is.
    """
    end = begin[-1]
    for t in range(times):
        if len(name) < 2:
            break
        edge = np.isin(start, begin)  # the first symbol of a text
        new = np.concatenate(([True], (name[1:] != name[:-1]) | edge[1:]))
        if not new.all():
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(name)))
            long = np.diff(np.append(start[first], end)) > LONGEST
            if long.any():
                new |= np.repeat(long, count)
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(name)))
            with np.errstate(over="ignore"):
                name = np.where(count > 1, _mix(name[first] * _B + count.astype(np.uint64)), name[first])
            start, edge = start[first], edge[first]
        size = np.diff(np.append(start, end))
        left = (_mix(name + np.uint64(t + 1)) & np.uint64(1)).astype(bool)
        pair = np.flatnonzero(left[:-1] & ~left[1:] & ~edge[1:] & (size[:-1] + size[1:] <= LONGEST))
        with np.errstate(over="ignore"):
            name[pair] = _mix(name[pair] * _MIX2 + _mix(name[pair + 1] + _B))
        keep = np.ones(len(name), dtype=bool)
        keep[pair + 1] = False
        name, start = name[keep], start[keep]
    return name, start


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(name, text number, position)`` of the anchors: the fewest symbols from one on that span ``ANCHOR`` characters of its text are named together,
    and a name is kept if it is the least of some ``NEIGHBOURS`` names in a row of its text.

    Of equal anchors of a text that follow each other within ``ANCHOR`` characters, as in a repeated pattern, the first is kept.
    """
    name, start, begin = tokens(texts)
    name, start = rounds(name, start, begin)
    if not len(name):
        return name, start, start
    of = np.searchsorted(begin, start, side="right") - 1
    until = np.searchsorted(start, start + ANCHOR)
    at = np.flatnonzero(start + ANCHOR <= begin[of + 1])
    most = int((until[at] - at).max()) if len(at) else 0
    key = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(most):  # no anchor has more symbols than ANCHOR has characters; most have five or six
            inside = at + k < until[at]
            key[inside] = _mix(key[inside] * _B + name[at[inside] + k])
    of, pos = of[at], start[at] - begin[of[at]]
    kept = _least(key, of)
    key, of, pos = key[kept], of[kept], pos[kept]
    order = np.lexsort((pos, of, key))
    same = (key[order][1:] == key[order][:-1]) & (of[order][1:] == of[order][:-1]) & (np.diff(pos[order]) < ANCHOR)
    keep = order[np.concatenate(([True], ~same))] if len(order) else order
    return key[keep], of[keep], pos[keep]


def _least(key: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Positions of the names that are the least of ``NEIGHBOURS`` names in a row of one text, or of all if it has fewer; equal ones all count."""
    n = len(key)
    out = np.zeros(n, dtype=bool)
    if not n:
        return np.flatnonzero(out)
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    last = np.append(first[1:], n)
    for i in range(NEIGHBOURS):
        # windows that begin i names before a name and end inside its text
        begin = np.maximum(np.arange(n) - i, np.repeat(first, last - first))
        end = np.minimum(begin + NEIGHBOURS, np.repeat(last, last - first))
        begin = np.maximum(end - NEIGHBOURS, np.repeat(first, last - first))
        low = key[begin].copy()
        for k in range(1, NEIGHBOURS):
            low = np.minimum(low, key[np.minimum(begin + k, end - 1)])
        out |= key == low
    return np.flatnonzero(out)


#: Characters that are parsed at once.
BATCH_CHARS = 500_000


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = chars = 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > BATCH_CHARS:
            yield first, i
            first, chars = i, 0
        chars += len(t)
    if first < len(texts):
        yield first, len(texts)


def anchor_table(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``key, doc_id, pos, before, gap`` of every anchor of documents that are long enough to share a stretch, with the document's anchor before it and how far
    back that is (-1: none)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, ids = b["text"].tolist(), b["doc_id"].to_numpy()
            for i, j in _groups(texts):
                key, of, pos = anchors(texts[i:j])
                order = np.lexsort((pos, of))
                key, of, pos = key[order].astype(np.int64), of[order], pos[order].astype(np.int32)
                new = np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
                before, gap = np.where(new, 0, np.roll(key, 1)), np.where(new, -1, pos - np.roll(pos, 1))
                yield pd.DataFrame({"key": key, "doc_id": ids[i:j][of], "pos": pos, "before": before, "gap": gap.astype(np.int32)})

    rows = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= least))
    return rows.mapInPandas(scan, "key long, doc_id long, pos int, before long, gap int")


def classes(documents: DataFrame) -> DataFrame:
    """``doc_id, class_id``: the smallest doc_id of the documents with the same text. Null texts and ids are left out."""
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.length("text").alias("n"))
    first = rows.groupBy("h", "n").agg(F.min("doc_id").alias("class_id"))
    return rows.join(first, ["h", "n"]).select("doc_id", "class_id", "n").distinct()


def _runs(a: str, b: str, shift: int, least: int) -> list[tuple[int, int]]:
    """``(start in a, length)`` of stretches of ``least`` or more that agree when b is shifted so that b[i] meets a[i + shift]."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    if hi - lo < least:
        return []
    x = np.frombuffer(a[lo:hi].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    y = np.frombuffer(b[lo - shift : hi - shift].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cut = np.concatenate(([-1], np.flatnonzero(x != y), [hi - lo]))
    gap = np.diff(cut) - 1
    return [(int(cut[k]) + 1 + lo, int(gap[k])) for k in np.flatnonzero(gap >= least)]


def candidates(anchor: DataFrame) -> DataFrame:
    """``a, b, shifts``: documents a < b with a common anchor, and by how much the texts must be shifted for one to meet the other.

    Anchors of one document only, and those that always follow the same one at the same distance, are dropped before any pair is made. The documents
    of an anchor are joined in pieces, so an anchor of many documents spreads over tasks.
    """
    keys = anchor.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    shared = materialise(anchor.join(materialise(keys, "shared-keys"), "key"), "shared-anchors")  # few of all: the join needs no shuffle while the keys are few
    link = F.struct("before", "gap")
    heads = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(link).alias("l"), F.max(link).alias("h")).where((F.col("l") != F.col("h")) | (F.col("l.gap") < 0))
    some = shared.select("key", "doc_id", "pos").join(heads.select("key", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")), "key")
    a = some.select("key", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int").alias("piece"), F.col("doc_id").alias("a"), F.col("pos").alias("pa"))
    b = some.select("key", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("doc_id").alias("b"), F.col("pos").alias("pb"))
    both = a.join(b, ["key", "piece"]).where(F.col("a") < F.col("b")).select("a", "b", (F.col("pa") - F.col("pb")).alias("shift"))
    return both.distinct().groupBy("a", "b").agg(F.collect_list("shift").alias("shifts"))


def stretches(documents: DataFrame, least: int = LEAST, own: DataFrame | None = None) -> DataFrame:
    """``a, b, start_a, start_b, length``: all shared stretches of ``least`` or more characters of documents a < b with different texts.

    One document stands for all that have its text. Texts are fetched once for each pair and compared over their whole length for every shift.
    ``own``: :func:`classes` of the documents, if they are at hand.
    """
    own = classes(documents) if own is None else own
    first = own.where((F.col("doc_id") == F.col("class_id")) & (F.col("n") >= least)).select("doc_id")
    texts = documents.select("doc_id", "text").join(first, "doc_id")
    pairs = materialise(candidates(materialise(anchor_table(texts, least), "anchors")), "pairs")
    side = lambda c: pairs.select(F.col(c).alias("doc_id")).distinct()
    used = texts.join(side("a").union(side("b")).distinct(), "doc_id")
    both = pairs.join(used.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(used.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = [(a, b, s, s - int(d), n) for a, b, shifts, ta, tb in zip(x["a"], x["b"], x["shifts"], x["ta"], x["tb"], strict=True) for d in shifts for s, n in _runs(ta, tb, int(d), least)]
            yield pd.DataFrame(out, columns=["a", "b", "start_a", "start_b", "length"])

    return both.mapInPandas(verify, "a long, b long, start_a int, start_b int, length int")


def links(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``class_a, class_b, stretches, longest``: pairs of different texts that share a stretch, named by their classes; :func:`classes` says which documents have each text."""
    return stretches(documents, least).distinct().groupBy(F.col("a").alias("class_a"), F.col("b").alias("class_b")).agg(F.count(F.lit(1)).alias("stretches"), F.max("length").alias("longest"))


def found(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id_a, doc_id_b`` with a < b of all documents that share a stretch, those with the same text included."""
    own = materialise(classes(documents).where(F.col("n") >= least), "classes")
    pairs = stretches(documents, least, own).select("a", "b").distinct()
    own = own.select("doc_id", "class_id")
    left, right = own.select(F.col("doc_id").alias("x"), F.col("class_id").alias("a")), own.select(F.col("doc_id").alias("y"), F.col("class_id").alias("b"))
    across = pairs.join(left, "a").join(right, "b").select("x", "y")
    within = left.join(right.withColumnRenamed("b", "a"), "a").where(F.col("x") < F.col("y")).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def coverage(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, class_id, n_chars, shared_chars, links``: how much of each document stands in others, and with how many texts it shares a stretch.

    A text that occurs more than once is shared whole. Overlapping stretches of a document count once, by a running maximum of their ends.
    """
    own = materialise(classes(documents), "classes")
    found_ = materialise(stretches(documents, least, own), "stretches")
    each = found_.select(F.col("a").alias("class_id"), F.col("b").alias("other"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e")).unionByName(
        found_.select(F.col("b").alias("class_id"), F.col("a").alias("other"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("length")).alias("e"))
    )
    links = each.groupBy("class_id").agg(F.count_distinct("other").alias("links"))
    before = Window.partitionBy("class_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    new = each.select("class_id", "s", "e").distinct().withColumn("reached", F.coalesce(F.max("e").over(before), F.lit(0)))
    chars = new.groupBy("class_id").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reached"))).alias("chars"))
    copies = own.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    out = own.join(copies, "class_id").join(chars, "class_id", "left").join(links, "class_id", "left")
    whole = (F.col("copies") > 1) & (F.col("n") >= least)
    return out.select("doc_id", "class_id", F.col("n").alias("n_chars"), F.when(whole, F.col("n")).otherwise(F.coalesce("chars", F.lit(0))).cast("long").alias("shared_chars"), F.coalesce("links", F.lit(0)).alias("links"))
