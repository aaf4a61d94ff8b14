"""Texts into containers of a fixed number of tokens.

Lengths are counted by Spark into one histogram (at most as many rows as the capacity). Dynamic programming over it chooses the length
buckets that minimise padding, that is, the tokens by which a bucket's longest item exceeds its others. Containers are planned on bucket
counts: each bucket forms batches of as many of its items as the token budget holds, and the room that is left takes items of shorter
buckets, tightest room first. The plan is a short list of kinds of container; items find theirs by their rank in the bucket, so no item
passes through the driver. A text longer than the capacity is cut into full containers and a rest, which is packed like any other.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Folder of public tokenizers on every executor, and the file for each name. Of cl100k_base and o200k_base no public file is at hand here,
#: so the vocabulary for many languages stands in for both.
TOKENIZERS = "/opt/tokenizers"
FILES = {"gpt2": "byte_bpe_50k.tiktoken", "cl100k_base": "byte_bpe_multi_50k.tiktoken", "o200k_base": "byte_bpe_multi_50k.tiktoken"}
# Fixed value: how these vocabularies split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Buckets at most, words that a worker remembers, items of a bucket that are ranked together.
BUCKETS, MEMORY, RANKED = 128, 1_000_000, 200_000


class Counter:
    """Tokens of a text. The split never joins text across a single space, so a text's count is the sum over its space-separated pieces."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.seen: dict[str, int] = {}

    def piece(self, text: str) -> int:
        n = self.seen.get(text)
        if n is None:
            if len(self.seen) >= MEMORY:
                self.seen.clear()
            n = self.seen[text] = len(self.encoding.encode_ordinary(text))
        return n

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if "   " in text or text[-1] == " ":
            return len(self.encoding.encode_ordinary(text))
        first, *rest = text.split(" ")
        get, total = self.seen.get, self.piece(first)
        for x in rest:
            n = get(key := " " + x)
            total += self.piece(key) if n is None else n
        return total


def token_counts(documents: DataFrame, names: list[str], folder: str = TOKENIZERS, files: dict[str, str] = FILES) -> DataFrame:
    """``doc_id, tokenizer_name, tokens`` of every document with an id; a null text has 0 tokens. An unknown tokenizer name is an error."""
    unknown = sorted(set(names) - set(files))
    if unknown:
        raise ValueError(f"no tokenizer file for {', '.join(unknown)}")
    of = {n: os.path.join(folder, files[n]) for n in sorted(set(names))}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = {p: Counter(p) for p in sorted(set(of.values()))}
        for b in batches:
            texts = b["text"].fillna("").tolist()
            got = {p: [c(t) for t in texts] for p, c in counters.items()}
            for name, p in of.items():
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "tokenizer_name": name, "tokens": got[p]})

    return documents.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInPandas(count, "doc_id long, tokenizer_name string, tokens long")


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total padding.

    ``lengths``: different lengths, rising; ``counts``: items of each. Dynamic programming in layers; in a layer the best predecessor is the
    lower envelope of lines, so a layer takes time in proportion to the lengths.
    """
    m = len(lengths)
    if m <= buckets:
        return [int(x) for x in lengths]
    c = np.concatenate(([0], np.cumsum(counts))).astype(float).tolist()
    s = np.concatenate(([0], np.cumsum(counts * lengths))).astype(float).tolist()
    u = [float(x) for x in lengths]
    best = [0.0] + [u[i - 1] * c[i] - s[i] for i in range(1, m + 1)]
    came = [[0] * (m + 1)]
    for _ in range(1, buckets):
        hull: list[tuple[float, float, int]] = []  # slope -c[j] falls, u rises: minimum by a pointer from the front
        at = 0
        new, back = [0.0] * (m + 1), [0] * (m + 1)
        for i in range(1, m + 1):
            j = i - 1
            k, b = -c[j], best[j] + s[j]
            while len(hull) - at >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - k):
                hull.pop()
            hull.append((k, b, j))
            x = u[i - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            new[i] = hull[at][0] * x + hull[at][1] + x * c[i] - s[i]
            back[i] = hull[at][2]
        best = new
        came.append(back)
    out, i = [], m
    for back in reversed(came):
        if i == 0:
            break
        out.append(int(lengths[i - 1]))
        i = back[i]
    return out[::-1]


class Kind(NamedTuple):
    """``count`` containers that hold, for each bucket, ``items[bucket]`` items."""

    count: int
    items: dict[int, int]


def plan(sizes: list[int], counts: list[int], capacity: int) -> list[Kind]:
    """Kinds of container for buckets of items of at most ``sizes`` tokens: longest bucket first, tightest open room first."""
    open_: list[list] = []  # [room, number, items]
    for b in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        left, size = counts[b], max(sizes[b], 1)
        made = []
        for kind in sorted(open_, key=lambda k: k[0]):
            room, number, items = kind
            fit = room // size
            if not left or not fit:
                continue
            full = min(number, left // fit)
            if full:
                made.append([room - fit * size, full, {**items, b: fit}])
                left -= full * fit
            if full < number and left:
                made.append([room - left * size, 1, {**items, b: left}])
                full, left = full + 1, 0
            kind[1] -= full
        fit = capacity // size
        if left >= fit:
            made.append([capacity - fit * size, left // fit, {b: fit}])
            left %= fit
        if left:
            made.append([capacity - left * size, 1, {b: left}])
        merged: dict[tuple, list] = {}
        for room, number, items in [*open_, *made]:
            if number:
                key = (room, tuple(sorted(items.items())))
                merged.setdefault(key, [room, 0, items])[1] += number
        open_ = list(merged.values())
    return [Kind(n, items) for _, n, items in open_]


def containers(counts: DataFrame, pack_targets: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``target_id, container_id, doc_id, first_token, tokens``: where each document's tokens go, for every target.

    Documents without tokens take no container. A document appears in several rows of a target only if it exceeds the capacity. A target
    with null or non-positive capacity gives no row. ``pack_targets`` is a short list of settings.
    """
    spark = counts.sparkSession
    out: DataFrame | None = None
    for t in pack_targets.where((F.col("capacity_tokens") > 0) & F.col("tokenizer_name").isNotNull()).distinct().collect():
        cap = int(t["capacity_tokens"])
        own = counts.where((F.col("tokenizer_name") == t["tokenizer_name"]) & (F.col("tokens") > 0)).select("doc_id", "tokens")
        pieces = own.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / cap)), lambda k: F.struct((k * cap).cast("long").alias("first_token"), F.least(F.lit(cap), F.col("tokens") - k * cap).cast("long").alias("size")))).alias("p"))
        items = pieces.select("doc_id", "p.first_token", "p.size")
        hist = items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").toPandas()
        upper = optimal_buckets(hist["size"].to_numpy(), hist["n"].to_numpy(), buckets)
        number = np.searchsorted(np.array(upper), hist["size"].to_numpy()) if upper else np.zeros(0, int)
        per = np.bincount(number, weights=hist["n"], minlength=len(upper)).astype(np.int64).tolist() if upper else []
        rows, used, first = [], [0] * len(upper), 0
        for kind in plan(upper, per, cap):
            for b, k in kind.items.items():
                rows.append((b, used[b], used[b] + kind.count * k, first, k))
                used[b] += kind.count * k
            first += kind.count
        slots = spark.createDataFrame(rows, "bucket int, lo long, hi long, start long, each int")
        bucket = F.array_position(F.array(*[F.lit(u) for u in upper]), F.element_at(F.filter(F.array(*[F.lit(u) for u in upper]), lambda u: u >= F.col("size")), 1)) - 1 if upper else F.lit(0)
        ranked = _ranks(items.withColumn("bucket", bucket.cast("int")), per)
        placed = ranked.join(F.broadcast(slots), (ranked["bucket"] == slots["bucket"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        got = placed.select(F.lit(int(t["target_id"])).alias("target_id"), (F.col("start") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("long").alias("container_id"), "doc_id", "first_token", F.col("size").alias("tokens"))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "target_id int, container_id long, doc_id long, first_token long, tokens long")


def _ranks(items: DataFrame, per: list[int], together: int = RANKED) -> DataFrame:
    """``items`` with ``rank``, from 0 in each bucket. A bucket of more than ``together`` items (``per``: items of each) is ranked in parts whose sizes are counted first."""
    parts = F.array(*[F.lit(max(1, -(-n // together))) for n in per]) if per else F.array(F.lit(1))
    salted = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "first_token"), F.get(parts, F.col("bucket"))).cast("int"))
    sizes = salted.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "part").orderBy("doc_id", "first_token")
    return salted.withColumn("r", F.row_number().over(inside) - 1).join(offset, ["bucket", "part"]).select("doc_id", "first_token", "size", "bucket", (F.col("r") + F.col("offset")).alias("rank"))


def packed(documents: DataFrame, pack_targets: DataFrame, folder: str = TOKENIZERS, files: dict[str, str] = FILES) -> DataFrame:
    """:func:`containers` of ``documents``. Texts are tokenised once; counts are written and read again for each target."""
    names = [r["tokenizer_name"] for r in pack_targets.where(F.col("tokenizer_name").isNotNull()).select("tokenizer_name").distinct().collect()]
    return containers(materialise(token_counts(documents, names, folder, files), "token-counts"), pack_targets)


def fill(placed: DataFrame, pack_targets: DataFrame) -> DataFrame:
    """``target_id, containers, tokens, fill``: share of the containers' room that is used."""
    per = placed.groupBy("target_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return per.join(pack_targets, "target_id").select("target_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
