"""Text that was read in a wrong character encoding: noisy-channel decoding over byte lattices.

A *channel* is a pair (encoding the bytes were in, encoding they were read in). A damaged token is turned back into bytes by the second and
laid out as a lattice by the first, and whole words are weighed by their frequency in the corpus, in which the true word is commoner than its
damaged form. A replacement character is a lost byte: a wildcard in the lattice of each channel, or in the text as it stands. Every word of the
corpus that fits the rest of the token is a reading; without one a channel's lattice is decoded by letter frequencies, and a token that no
channel explains stays as it is. A Viterbi search runs over the suspicious tokens of a field, with one state for each channel, as damage comes in
stretches of one channel.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise, product
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import pages

LOST = "�"
FIELDS = ("extracted_text", "document_title", "meta_description")
#: (bytes were in, were read in). "twice": UTF-8 read as cp1252, written as UTF-8 and read so again.
CHANNELS = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("utf-8", "cp437"),
    ("twice", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "cp1251"), ("cp1252", "cp1250"),
    ("mac_roman", "cp1252"), ("mac_roman", "latin-1"), ("cp850", "cp1252"), ("cp850", "latin-1"),
)
LOST_BYTES = len(CHANNELS)  # the channel that only loses bytes
#: Greatest share of a word's uses that one channel has damaged: so many uses of a damaged form say nothing for it.
DAMAGED_SHARE = 0.02
#: Log cost of a token that is sound as it stands inside a damaged stretch, and the most that a reading without letters can gain over a mark.
SOUND, MARK_GAIN = 2.0, 1.0
#: Log costs: being damaged at all, changing the channel, a word that the corpus lacks from a channel of single bytes; log gain of bytes that form UTF-8.
DAMAGE, SWITCH, UNSEEN, VALID = 3.0, 4.0, 6.0, 7.0
#: How far below the token as it stands a reading may score and still be carried to the field's search.
SLACK = 3.0
#: Share that the commonest word must have of all uses of words that fit a token with lost bytes; else what was lost can't be known.
KNOWN_SHARE = 0.5
#: Weight of the letter model against a count of one.
PRIOR = 50.0
# Letters and marks that texts in the languages at hand lose to wrong encodings.
LETTERS = "äöüßÄÖÜéèêëàâáãåçñíìîïóòôõúùûæœøÆØÅÉÈÊÀÂÁÃÇÑÍÓÔÚ’–“”„«»…€©°±µ·•¦"


def _single(name: str) -> tuple[dict[str, int], dict[int, str]]:
    """Character to byte, and byte to character, of a one-byte encoding; undefined bytes stand for control characters as browsers read them."""
    back: dict[int, str] = {}
    for b in range(256):
        try:
            back[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            back[b] = chr(b)
    return {c: b for b, c in back.items()}, back


_NAMES = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp850", "cp437")


def _undefined(name: str) -> tuple[int, ...]:
    out = []
    for b in range(0x80, 0xC0):
        try:
            bytes([b]).decode(name)
        except UnicodeDecodeError:
            out.append(b)
    return tuple(out)


#: Continuation bytes that an encoding doesn't know.
_UNDEFINED = {x: _undefined(x) for x in _NAMES}
_CODE = {x: _single(x) for x in _NAMES}


#: Opening and closing quotes that end a token, unless they are what a wrong decoding made of a letter.
MARKS = "„“«"
#: First bytes of UTF-8 for Latin letters, Greek, Cyrillic, Hebrew and Arabic, and of three bytes for marks, symbols and rarer Latin letters.
#: Others would take words such as CAFÉ, MENÜ or Spaß before a quote for the start of a character of far scripts.
LEAD_2, LEAD_3 = (*range(0xC2, 0xC6), *range(0xCE, 0xD2), *range(0xD7, 0xDA)), (0xE1, 0xE2, 0xEF)


def _mark() -> str:
    """Pattern of a mark inside a token: it completes or continues a character of UTF-8 read by one byte, or stands between letters."""
    places = ["(?<=[A-Za-zÀ-ɏ].)(?=[A-Za-zÀ-ɏ])"]
    for read in sorted({r for t, r in CHANNELS if t == "utf-8"}):
        back, char = _CODE[read]
        marks = "".join(c for c in MARKS if 0x80 <= back.get(c, 0) < 0xC0)
        two, three, rest = ("".join(char[b] for b in x) for x in (LEAD_2, LEAD_3, range(0x80, 0xC0)))
        if marks:
            places += [f"(?<=[{two}][{marks}])", f"(?<=[{three}][{marks}])(?=[{rest}])", f"(?<=[{three}][{rest}][{marks}])"]
    return f"[{MARKS}](?:{'|'.join(places)})"


#: A run of anything but white space, ASCII punctuation and free marks that holds a character beyond ASCII.
_REST = rf"[^\x00-\x20!-/:-@\[-`{{-~{MARKS}]*+"
TOKEN = rf"(?<![0-9A-Za-z])[0-9A-Za-z]*+(?=[^\x00-\x7f])(?:[^\x00-\x7f{MARKS}]|{_mark()}){_REST}(?:{_mark()}{_REST})*+"


def _bytes(text: str, read: str) -> bytes | None:
    table = _CODE[read][0]
    out = bytearray()
    for c in text:
        b = table.get(c)
        if b is None:
            return None
        out.append(b)
    return bytes(out)


def undo(token: str, channel: int) -> str | None:
    """What ``token`` was before ``channel``; null if the channel can't have made it, or leaves it as it is."""
    true, read = CHANNELS[channel]
    raw = _bytes(token, read)
    if raw is None:
        return None
    if true in ("utf-8", "twice"):
        try:
            out = raw.decode("utf-8")
            if true == "twice":
                again = _bytes(out, read)
                out = again.decode("utf-8") if again is not None else None
        except UnicodeDecodeError:
            return None
    else:
        table = _CODE[true][1]
        out = "".join(table[b] for b in raw)
    return out if out and out != token and all(c.isprintable() or c == "\xa0" for c in out) else None


def wild_columns(token: str, channel: int) -> list[tuple[str, ...]] | None:
    """The byte lattice of a token with lost bytes under a channel from UTF-8, one column of possible characters each; null if the channel can't have made the token.

    A lost byte stands for any byte, first of all those that the reading encoding leaves undefined, as these are what is lost; the others only count
    where none of these completes a character.
    """
    true, read = CHANNELS[channel]
    if true != "utf-8":
        return None
    table = _CODE[read][0]
    raw: list[int | None] = []
    for c in token:
        b = None if c == LOST else table.get(c)
        if b is None and c != LOST:
            return None
        raw.append(b)
    out: list[tuple[str, ...]] = []
    decoded = False
    i = 0
    while i < len(raw):
        lead = raw[i]
        if lead is None:
            return None  # a character whose first byte is lost is left to the words of the corpus
        size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        part = raw[i : i + size]
        if not size or len(part) < size or any(b is not None and not 0x80 <= b < 0xC0 for b in part[1:]):
            return None
        for choices in (_UNDEFINED[read], range(0x80, 0xC0)):
            found = []
            for tail in product(*[(b,) if b is not None else choices for b in part[1:]]):
                try:
                    c = bytes((lead, *tail)).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if c.isprintable() or c == "\xa0":
                    found.append(c)
            if found:
                break
        if not found:
            return None
        decoded |= size > 1
        out.append(tuple(found))
        i += size
    return out if decoded else None


def best_path(columns: list[tuple[str, ...]], letter: dict[str, float]) -> str:
    """The likeliest path through a lattice by Viterbi search under letter frequencies; a capital after a small letter costs."""
    best: dict[str, tuple[float, str]] = {"": (0.0, "")}
    for column in columns:
        new: dict[str, tuple[float, str]] = {}
        for c in column:
            own = letter.get(c, -14.0) if len(column) > 1 else 0.0
            new[c] = max(((score + own - (6.0 if last.islower() and c.isupper() and len(column) > 1 else 0.0), text + c) for last, (score, text) in best.items()), key=lambda x: x[0])
        best = new
    return max(best.values(), key=lambda x: x[0])[1]


#: Characters that a lost byte may have belonged to: Latin letters beyond ASCII, marks and symbols.
_WILD = "\xa0-\u024f\u1e00-\u1eff\u2010-\u22ff"


def frame(token: Column) -> Column:
    """What a damaged token and all words that may fit it have in common: each run of lost bytes and of characters beyond ASCII becomes one sign."""
    return F.regexp_replace(token, f"[{_WILD}{LOST}]+", LOST)


@lru_cache(4096)
def _fitting(token: str) -> re.Pattern[str]:
    parts = re.split(f"({LOST}+)", token)
    return re.compile("".join(f"[{_WILD}]{{{-(-len(x) // 3)},{len(x)}}}" if x.startswith(LOST) else re.escape(x) for x in parts))


def fits(token: str, word: str) -> bool:
    """Whether losing bytes can turn ``word`` into ``token``: a run of replacement characters stands for characters of one to three bytes each.
    Words that are damaged themselves are none: UTF-8 in a wrong reading, or a small letter before a capital, one of them beyond ASCII."""
    if _fitting(token).fullmatch(word) is None or any(a.islower() and b.isupper() and not (a + b).isascii() for a, b in pairwise(word)):
        return False
    return all(undo(word, k) is None for k, (t, _) in enumerate(CHANNELS) if t in ("utf-8", "twice"))


def readings(token: str) -> list[tuple[int, str]]:
    """``(channel, what the token was)`` for every channel that can have made a token without lost bytes."""
    return [(k, got) for k in range(len(CHANNELS)) if (got := undo(token, k)) is not None]


class Pattern(NamedTuple):
    """What a token with lost bytes may be: its text with each open character as a replacement character, and the characters that may stand in its place (null: any)."""

    channel: int
    text: str
    columns: list[tuple[str, ...]] | None


def patterns(token: str) -> list[Pattern]:
    """The token as it stands, and what every channel's lattice leaves open."""
    out = [Pattern(LOST_BYTES, token, None)]
    for k in range(len(CHANNELS)):
        columns = wild_columns(token, k)
        if columns:
            out.append(Pattern(k, "".join(c[0] if len(c) == 1 else LOST for c in columns), columns))
    return out


_ALNUM = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_BEYOND = re.compile(r"[^\x00-\x7f]")
_FROM = re.compile(rf"(?:[^\x00-\x7f{MARKS}]|{_mark()}){_REST}(?:{_mark()}{_REST})*+")


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every match of ``TOKEN``, found from its first character beyond ASCII, so that ASCII text costs nothing."""
    out: list[tuple[int, int]] = []
    end = 0
    while (m := _BEYOND.search(text, end)) is not None:
        at = m.start()
        got = _FROM.match(text, at)
        if got is None:
            end = at + 1
            continue
        start = at
        while start > end and text[start - 1] in _ALNUM:
            start -= 1
        end = got.end()
        out.append((start, end))
    return out


def fields(table: DataFrame) -> DataFrame:
    """``pid, field_name, tokens``: tokens beyond ASCII of the three fields. Absent columns and null fields give no row."""
    have = [f for f in FIELDS if f in table.columns]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in have]))
    rows = table.where(F.col("original_archived_url").isNotNull()).select(pages.page_id().alias("pid"), each.alias("x"))
    own = rows.where(F.col("x.text").rlike(r"[^\x00-\x7f]")).select("pid.a", "pid.b", "x.field_name", "x.text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [[t[i:j] for i, j in spans(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "field_name")), pa.array(tokens, pa.list_(pa.string()))], names=["a", "b", "field_name", "tokens"])

    return own.mapInArrow(cut, "a long, b long, field_name string, tokens array<string>").select(F.struct("a", "b").alias("pid"), "field_name", "tokens")


class Model(NamedTuple):
    """Number of tokens beyond ASCII and log frequency of each of their characters."""

    total: float
    letter: dict[str, float]

    def spelled(self, word: str) -> float:
        """Log probability of the spelling alone."""
        return sum(self.letter.get(c, -14.0) for c in word)


def letter_model(freq: DataFrame) -> Model:
    """Character frequencies, counted by Spark; the result has one row for each character, at most the size of Unicode in use."""
    rows = freq.select(F.explode(F.split("token", "")).alias("c"), "n").where(F.col("c") != "").groupBy("c").agg(F.sum("n").alias("n")).collect()
    total = float(sum(r["n"] for r in rows)) or 1.0
    return Model(total, {r["c"]: math.log(r["n"] / total) for r in rows})


def suspicious(freq: DataFrame) -> DataFrame:
    """``token, clean, options``: tokens that some channel may have damaged, with the log score of the token as it stands and of each reading.

    Readings meet the corpus frequencies in a shuffled join, so no vocabulary is broadcast.
    """
    model = letter_model(freq)
    is_lost = F.col("token").contains(LOST)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for token, n in zip(batch["token"], batch["n"], strict=True):
                spelled = model.spelled(token)
                for channel, text in readings(token):
                    out.append((token, int(n), spelled, channel, text, model.spelled(text)))
            yield pd.DataFrame(out, columns=["token", "n", "spelled", "channel", "text", "text_spelled"])

    options = freq.where(~is_lost).mapInPandas(expand, "token string, n long, spelled double, channel int, text string, text_spelled double")
    known = freq.select(F.col("token").alias("text"), F.col("n").alias("text_n"))
    both = options.join(known, "text", "left").withColumn("text_n", F.coalesce("text_n", F.lit(0)))
    log_p = lambda n, s: F.log(F.greatest(n, F.lit(0)) + F.lit(PRIOR) * F.exp(s) + F.lit(1e-30))
    utf8 = F.col("channel").isin([k for k, (t, _) in enumerate(CHANNELS) if t in ("utf-8", "twice")])
    score = log_p(F.col("text_n"), F.col("text_spelled")) + F.when(utf8, VALID).when((F.col("text_n") == 0) | (F.col("text_spelled") < F.col("spelled")), -UNSEEN).otherwise(0.0)
    own = F.col("n") - 1 - F.least(F.col("n") - 1, F.max(F.col("text_n") * DAMAGED_SHARE).over(Window.partitionBy("token")))
    clean = log_p(own, F.col("spelled"))
    mark = ~utf8 & ~F.col("text").rlike(r"\p{L}") & ~F.col("token").rlike(r"^\p{L}+$")
    best = both.withColumn("clean", clean).withColumn("score", F.when(mark, F.least(score, F.col("clean") + MARK_GAIN)).otherwise(score))
    best = best.where(F.col("score") > F.col("clean") - SLACK)
    best = best.groupBy("token").agg(F.first("clean").alias("clean"), F.collect_list(F.struct("channel", "score", "text")).alias("options"))
    return best.unionByName(lost_words(freq.where(is_lost), freq.where(~is_lost), model))


def lost_words(lost: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """``token, clean, options`` for tokens with lost bytes: the word that fits one of its :func:`patterns`, of all ``words``, if most uses are its own; without any what
    a channel's lattice gives by letter frequencies; else the token itself."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for token in batch["token"]:
                for x in patterns(token):
                    out.append((token, x.channel, x.text, best_path(x.columns, model.letter) if x.columns else None))
            yield pd.DataFrame(out, columns=["token", "channel", "pattern", "likely"])

    open_ = lost.select("token").mapInPandas(expand, "token string, channel int, pattern string, likely string")
    words = words.select(F.col("token").alias("text"), "n", frame(F.col("token")).alias("frame"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [fits(p, w) if k == LOST_BYTES else _inside(t, k, w) for t, k, p, w in zip(batch["token"], batch["channel"], batch["pattern"], batch["text"], strict=True)]
            yield batch[keep][["token", "text", "n"]]

    pairs = open_.withColumn("frame", frame(F.col("pattern"))).join(words, "frame").select("token", "channel", "pattern", "text", "n").mapInPandas(fit, "token string, text string, n long")
    once = pairs.distinct().groupBy("token").agg(F.max(F.struct("n", "text")).alias("top"), F.sum("n").alias("all"))
    top = once.select("token", F.when(F.col("top.n") >= KNOWN_SHARE * F.col("all"), F.col("top")).alias("top"), F.lit(True).alias("any"))
    own = open_.groupBy("token").agg(F.min_by("likely", F.when(F.col("likely").isNotNull(), F.col("channel"))).alias("likely"))
    text, n = F.coalesce("top.text", F.when(F.col("any").isNull(), F.col("likely")), "token"), F.coalesce("top.n", F.lit(0))
    option = F.struct(F.lit(LOST_BYTES).alias("channel"), F.log(n + 1.0).alias("score"), text.alias("text"))
    return own.join(top, "token", "left").select("token", F.lit(-99.0).alias("clean"), F.array(option).alias("options"))


def _inside(token: str, channel: int, word: str) -> bool:
    """Whether a word is a path through the lattice of a channel."""
    columns = wild_columns(token, channel)
    return columns is not None and len(columns) == len(word) and all(c in x for c, x in zip(word, columns, strict=True))


def decide(tokens: list[tuple[int, float, list[tuple[int, float, str]]]]) -> dict[int, str]:
    """Viterbi search over the suspicious tokens of a field: position to what stands there truly, for those that are damaged.

    ``tokens``: (position, score as it stands, [(channel, score, text)]) in any order.
    """
    tokens = sorted(tokens, key=lambda x: x[0])
    clean = -1
    best: dict[int, tuple[float, list[str | None]]] = {clean: (0.0, []), **{k: (-DAMAGE, []) for k in range(LOST_BYTES)}}
    before = -1
    for at, as_is, options in tokens:
        sound, before = at - before - 1, at
        read: dict[int, tuple[float, str]] = {}
        for k, s, text in options:
            if k not in read or s > read[k][0]:
                read[k] = (s, text)
        top = max(best.values(), key=lambda x: x[0])
        lost = read.get(LOST_BYTES)
        new: dict[int, tuple[float, list[str | None]]] = {}
        for k in best:
            enter = top[0] - (SWITCH if k >= 0 else 0.5)
            stay = best[k][0] - (SOUND * sound if k >= 0 and before > sound else 0.0)
            came = (stay, best[k][1]) if stay >= enter else (enter, top[1])
            if lost is not None:
                new[k] = (came[0] + lost[0], [*came[1], lost[1]])
            elif k >= 0 and k in read:
                new[k] = (came[0] + read[k][0], [*came[1], read[k][1]])
            else:
                new[k] = (came[0] + as_is - (1.0 if k >= 0 else 0.0), [*came[1], None])
        best = new
    path = max(best.values(), key=lambda x: x[0])[1]
    return {t[0]: text for t, text in zip(tokens, path, strict=True) if text is not None}


def repairs(table: DataFrame) -> DataFrame:
    """``pid, field_name, at, token, text``: every damaged token of every field, its number among the field's tokens, and what it was."""
    own = materialise(fields(table), "tokens")
    freq = materialise(own.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token-counts")
    odd = suspicious(freq)
    occurs = own.select("pid", "field_name", F.posexplode("tokens").alias("at", "token")).join(odd, "token")
    per_field = occurs.groupBy("pid", "field_name").agg(F.collect_list(F.struct("at", "token", "clean", "options")).alias("seen"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pid, name, seen in zip(batch["pid"], batch["field_name"], batch["seen"], strict=True):
                unique = {x["at"]: x for x in seen}
                got = decide([(a, x["clean"], [(o["channel"], o["score"], o["text"]) for o in x["options"]]) for a, x in unique.items()])
                out += [(pid["a"], pid["b"], name, a, unique[a]["token"], text) for a, text in got.items()]
            yield pd.DataFrame(out, columns=["a", "b", "field_name", "at", "token", "text"])

    got = per_field.mapInPandas(search, "a long, b long, field_name string, at int, token string, text string")
    return got.select(F.struct("a", "b").alias("pid"), "field_name", "at", "token", "text")


def found(table: DataFrame) -> DataFrame:
    """Page key and ``field_name`` of every field with a damaged or lost character, once."""
    damaged = repairs(table).select("pid", "field_name").distinct()
    keys = table.where(F.col("original_archived_url").isNotNull()).select(*pages.KEY, pages.page_id().alias("pid")).distinct()
    return keys.join(damaged, "pid").select(*pages.KEY, "field_name")


def restored(table: DataFrame) -> DataFrame:
    """Page key, ``field_name``, the field as stored and ``restored``, for every damaged field. What can't be known stays as it is."""
    per = repairs(table).groupBy("pid", "field_name").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("at", "text")))).alias("changes"))
    have = [f for f in FIELDS if f in table.columns]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in have]))
    rows = table.where(F.col("original_archived_url").isNotNull()).select(*pages.KEY, pages.page_id().alias("pid"), each.alias("x"))
    rows = rows.select(*pages.KEY, "pid", "x.field_name", "x.text").join(per, ["pid", "field_name"])

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = [apply(t, {int(k): v for k, v in (c.items() if isinstance(c, dict) else c)}) for t, c in zip(b["text"], b["changes"], strict=True)]
            yield b[[*pages.KEY, "field_name", "text"]].assign(restored=new)

    return rows.mapInPandas(put, f"{pages.KEY_SCHEMA}, field_name string, text string, restored string").distinct()


def apply(text: str, changes: dict[int, str]) -> str:
    """``text`` with its tokens beyond ASCII of the given numbers replaced."""
    out, before = [], 0
    for n, (i, j) in enumerate(spans(text)):
        if n in changes:
            out += [text[before:i], changes[n]]
            before = j
    return "".join([*out, text[before:]])
