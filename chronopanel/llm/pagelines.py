"""One line of a page and what it is by itself. Pure Python, no Spark.

Kinds: ``prose`` (sentences), ``head`` (short text without end mark), ``list``, ``table``, ``junk`` (code, symbols, random words),
``notice`` (error, maintenance, parking), ``filler``, ``script`` (script notice) and the kinds of chrome of :mod:`lexicon`
(``menu``, ``trail``, ``teaser``, ``cookie``, ``share``, ...). The whole line is read, whatever its length, by the same rules: phrases
are weighed sentence by sentence, counts of signs against the line's length. What a kind means for a page is decided in :mod:`layout`.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from . import lexicon as lx

SPACES = re.compile(r"[\t\xa0 ]+")
_SEPARATORS = ("/", ";", ">", "\t", " - ", "  ", "·", "»", "«", "›", "•", "¦")
_TRAIL = tuple(lx.fragments(lx.TRAIL))
_FIND = lx.automaton({"filler": lx.FILLER, "script": lx.SCRIPT, "notice": lx.NOTICE, **lx.PROMPTS})
_NOTICE_START = tuple(lx.fragments(lx.NOTICE))
_MENU_START = frozenset(lx.skeleton(x.split(" ")[0]) for words in lx.MENU.values() for x in words.split(";"))
_WHOLE = frozenset(lx.fragments(lx.WHOLE))
_TEASERS = frozenset(lx.fragments(lx.TEASERS))
_MORE = tuple(lx.fragments(lx.MORE))
_RAW = re.compile(lx.RAW, re.I)
_ON_LINE = re.compile(r"\bon line \d+$")
_RIGHTS = re.compile(r"^(?:©|\(c\)|copyright)\W{0,3}(?:19|20)?\d\d|^(?:\(c\)|copyright|©)\D{1,8}(?:19|20)\d\d", re.I)
_YEARS = re.compile(r"^\D{1,8}(?:19|20)\d\d\D{1,9}(?:19|20)\d\d\D")
_SIGN_YEARS = re.compile(r"^[^\d ]{0,3}[^\w ] ?(?:19|20)\d\d[^\s\da-z]{1,6}(?:19|20)\d\d ")
_PHONE = re.compile(r"^[^\d]{2,16}[\d /()+.\- –]{6,24}$")
_PHONE_KEYS = frozenset("tel tl phone telefon telefono telfono fax tlphone telefoon fon mobil mobile t".split())
_ADDRESS = re.compile(r",\s[^,]{2,60}\s\d{1,4}\s?[a-z]?,\s\d{4,5}\s\S")
_DATED = re.compile(r"^\d\d?\.\d\d?\.\d{4}\s\S")
_LEGAL = re.compile(r"(?:GmbH(?: & Co\. KG)?|AG|KG|OHG|e\.? ?K\.?|SE|S\.?A\.?|S\.?r\.?l\.?|SpA|B\.?V\.?|Ltd\.?|Inc\.?|LLC)$", re.I)
_BULLET = re.compile(r"^(?:[-*•–·]|\d{1,3}[.)])\s\S")
_CODE_END = re.compile(r"\b[A-Z]{2}[ /-]?\d{2,5}$")
_CELL = re.compile(r"^(?:-|\d[\d.,]*\s?\S{0,4})$")
_UNIT = re.compile(r"(?:^| )(?:kg|kW|Nm|mm|cm|bar|l/h|°C|€|%|m²|V|A|\S?C|\S{1,3})$")
_EXTENSION = re.compile(r"^[^\d.:]{5,60}, [^\d.,]{3,14} \d[\d.]*$")
_ODD_SEP = re.compile(r"\s[^\x00-\x7f\w]?[^\x00-\x7f]{1,3}\s")
_CREDIT = re.compile(r"^[^\W\d]\S*(?: \S+){0,2} ?: [^,.]{3,60}$")
_PLACE_ITEM = re.compile(r"^[^\s,][^,.!?]{2,40}, \S[^,.!?]{4,50}$")
_SLOGAN = re.compile(r"^[^\W\d_][^\s.:–!?,]*(?: [^\s.:–!?,]+){1,2}(?:\.|:| –) [^\W\d_][^\s.:–!?,]*(?: [^\s.:–!?,]+){1,2}\.?$")
_CODELIKE = re.compile(r"function\s*\(|\bvar \w+\s*=|;\}|\)\s*\{|=>|\breturn\b[^;]*;|</?\w+[^<>]*>|\w\(\w*\);")
_CODE_SIGNS = ";{}=<>"
_WORD = re.compile(r"[^\W_]+")
_DIGITS = "0123456789"
_MIXED = re.compile(r"^(?=\w*\d)(?=\w*[a-z])\w+$")
_SENTENCE = re.compile(r"(?<=[.!?]) ")
_ODD_CHAR = re.compile(r"[^\w\s]|_")

#: Kinds in the order of their codes; code 0 is an empty line.
KINDS = (
    "", "prose", "head", "list", "table", "junk", "notice", "filler", "script", "menu", "trail", "teaser", "dated", "slogan", "footer", "phone", "address",
    *lx.PROMPTS,
)
CODE = {k: i for i, k in enumerate(KINDS)}
#: Prompts known by a part of the sentence; the others must fill most of it.
_SURE = frozenset(("change", "toolbar", "cookie", "letter", "credit", "site", "share"))


class Line(NamedTuple):
    """A line without its surroundings."""

    text: str
    kind: str
    words: int


def tidy(line: str) -> str:
    """No-break spaces and tabs as spaces, runs of spaces as one, trimmed."""
    if "\t" in line or "\xa0" in line or "  " in line:
        line = SPACES.sub(" ", line)
    return line.strip(" ")


def _menu(raw: str, text: str, sk: str, words: list[str]) -> bool:
    if sk in lx.MENU_KEYS:
        return len(text) < 2 * len(sk) + 12
    own = raw.replace("\xa0", " ") if "\xa0" in raw else raw
    present = [x for x in _SEPARATORS if x in own]
    if present or "|" in own:
        for x in present:
            own = own.replace(x, "|")
        parts = [p for p in map(lx.skeleton, own.split("|")) if p]
        if len(parts) >= 2 and sum(p in lx.MENU_KEYS for p in parts) >= 0.6 * len(parts):
            return True
    if len(words) >= 3 and text[-1] not in ".!?" and lx.skeleton(words[0]) in _MENU_START:  # labels with nothing but single spaces between them
        i = hit = 0
        while i < len(words):
            for k in (3, 2, 1):
                if lx.skeleton("".join(words[i : i + k])) in lx.MENU_KEYS:
                    hit, i = hit + k, i + k
                    break
            else:
                i += 1
        return hit >= 0.8 * len(words)
    return False


def _table(raw: str) -> bool:
    own = raw.strip()
    for sep in ("\t", " ¦ ", " | ", ";", "   ", "  ", " ; "):
        if sep in raw:
            cells = [c.strip() for c in own.split(sep) if c.strip()]
            if len(cells) >= 3 and (sum(bool(_CELL.match(c)) for c in cells[1:]) >= 0.6 * (len(cells) - 1) or all(_UNIT.search(c) and len(c) < 40 for c in cells[1:]) and len(cells[0]) < 20):
                return True
    if not own.isascii() and sum(map(own.count, "0123456789-")) > 1:
        cells = [c for c in _ODD_SEP.split(own) if c]
        if len(cells) >= 3 and sum(bool(_CELL.match(c)) for c in cells[1:]) >= 0.6 * (len(cells) - 1):
            return True
    words = raw.split()
    return len(words) >= 5 and own[-1:] not in ".!?" and sum(w == "-" or w[0].isdigit() for w in words) >= 0.4 * len(words) and not _random(words)


def _random(words: list[str]) -> bool:
    return sum(1 for w in words if _MIXED.match(w)) >= 0.4 * len(words)


#: Words of a paragraph that are looked at together for made-up Latin and keyboard mash.
WINDOW = 14
_MASH_STARTS = frozenset(lx.LOREM[i : i + 5] for i in range(len(lx.LOREM) - 4)) | {w[:5] for w in lx.MASH}


def _mash(low: str) -> bool:
    return low in lx.MASH or low[:3] == "jkl" or len(low) > 1 and not low.strip("x") or len(low) >= 5 and low[:5] in lx.LOREM


def _sane(starts: list[str]) -> bool:
    """Whether none of some words is mash, by their first five letters; doubtful ones are none."""
    if not _MASH_STARTS.isdisjoint(starts):
        return False
    all_ = " ".join(starts)
    return not ("jkl" in all_ or "xx" in all_)


def is_lorem(words: list[str]) -> bool:
    """Made-up Latin or keyboard mash: most words, and at least four."""
    low = [w.lower() for w in words]
    return len(low) >= 4 and not _sane([w[:5] for w in low]) and sum(map(_mash, low)) >= 0.6 * len(low)


def has_lorem(words: list[str], low: list[str]) -> bool:
    """Whether any ``WINDOW`` words in a row, or all if they are fewer, are made-up Latin or keyboard mash; ``low``: the words in lower case.

    Of two words in a row one is at an even place, so a window of which most words are mash has some of them there.
    """
    if len(words) <= WINDOW:
        return is_lorem(words)
    if _sane([w[:5] for w in low[::2]]):
        return False
    hits = [_mash(w) for w in low]
    now = sum(hits[:WINDOW])
    for old, new in zip(hits, [*hits[WINDOW:], False], strict=False):
        if now >= 0.6 * WINDOW:
            return True
        now += new - old
    return False


def ends_sentence(text: str) -> bool:
    """Whether a line ends in an end mark, closing quotes and one bracketed remark after it aside."""
    own = text[:-1] if text.endswith(").") else text
    if own.endswith(")") and (at := own.rfind(" (")) > 0 and own[:at].rstrip("\"”“»’')]")[-1:] in tuple(".!?…;:"):
        return True
    return text.rstrip("\"”“»’')]")[-1:] in tuple(".!?…;:")


def _phrases(text: str) -> str:
    """Kind of a line by the phrases that its sentences hold, ``''`` for none.

    Filler counts anywhere. A line is a notice if it opens with one and the rest isn't over twice as long, and a script notice or a prompt if
    sentences of that kind hold at least a third of its words. What follows the last end mark doesn't count against them.
    """
    parts = _SENTENCE.split(text)
    size: dict[str, int] = {}
    total = 0
    for k, s in enumerate(parts):
        sk = lx.skeleton(s)
        nw = s.count(" ") + 1
        total += nw if not k or s[-1:] in ".!?" else 0
        hits = [(end + 1 - size_, kind, size_) for end, (kind, size_) in _FIND.iter(sk)]
        own = ""
        for start, kind, part in hits:
            if kind == "filler":
                return kind
            if kind == "script" and len(sk) < max(2.5 * part + 30, 8 * part) or kind == "notice" and (start <= 12 and part > 0.25 * len(sk) or start <= 2):
                own = kind
                break
        if not own:
            for _, kind, part in sorted(hits, key=lambda x: -x[2]):
                if kind in lx.PROMPTS and (part > 0.6 * len(sk) or kind in _SURE and part > 0.15 * len(sk) or nw <= 6):
                    own = kind
                    break
        if own and (own != "notice" or not k or "notice" in size):
            size[own] = size.get(own, 0) + nw
    if 3 * size.get("notice", 0) >= total:
        return "notice"
    best = max(size, key=lambda x: size[x], default="")
    return best if best and best != "notice" and 3 * size[best] >= total else ""


def classify(raw: str) -> Line:
    """Kind of one line by itself. Any text is accepted; an empty line has kind ``''``."""
    return _remembered(raw) if len(raw) < 200 else _classify(raw)


def _classify(raw: str) -> Line:
    text = tidy(raw)
    if not text:
        return Line("", "", 0)
    words = text.split(" ")
    nw = len(words)
    return Line(text, _kind(raw, text, words, nw), nw)


_remembered = lru_cache(maxsize=100_000)(_classify)


def _kind(raw: str, text: str, words: list[str], nw: int) -> str:
    n = len(text)
    low = text.lower()
    sk = lx.letters(low)
    signs = sum(map(text.count, _CODE_SIGNS))
    sentence = nw >= 5 and text[-1] in ".!?“”\")’"
    if sk.startswith(_NOTICE_START) and _phrases(text) == "notice":
        return "notice"
    if _menu(raw, text, sk, words):
        return "menu"
    if _RIGHTS.match(text) or _SIGN_YEARS.match(text) or not sentence and _YEARS.match(text):
        return "footer"
    if sk in _PHONE_KEYS and _PHONE.match(text) and sum(map(text.count, _DIGITS)) >= 6:
        return "phone"
    if sk in _TEASERS:
        return "teaser"
    if sk in _WHOLE:
        return "share"
    if sk.startswith(_TRAIL):
        return "trail"
    if text[0].isdigit() and _DATED.match(text) and not _SENTENCE.search(text, 11):
        return "dated"
    if _RAW.match(text) or text[-1].isdigit() and _ON_LINE.search(text):
        return "notice"
    if next(_FIND.iter(sk), None) and (got := _phrases(text)):
        return got
    if nw > WINDOW:
        if has_lorem(words, low.split(" ")):
            return "filler"
    elif is_lorem(_WORD.findall(text)):
        return "filler"
    if "," in text and (m := _ADDRESS.search(text)) and 3 * (m.end() - m.start()) >= n:
        return "address"
    if not sentence or signs > 2 or "|" in raw or "\t" in raw or "  " in raw:
        if _table(raw):
            return "table"
        if signs > 2 and text.count(";") > 0.3 * nw and 8 * len(_CODELIKE.findall(text)) >= nw:
            return "junk"
    if _BULLET.match(text):
        return "list"
    if sk.endswith(_MORE):
        return "dated"
    if " · " in text and _LEGAL.search(text):
        return "slogan"
    if ":" in text and _LEGAL.search(text) and _CREDIT.match(text):
        return "credit"
    if len(sk) + nw < 0.7 * n and n - len(_ODD_CHAR.findall(text)) < 0.7 * n:
        return "junk"
    if signs and 8 * (signs + text.count("function")) >= nw and 8 * len(_CODELIKE.findall(text)) >= nw:
        return "junk"
    if len(sk) < 0.5 * n and 2 * sum(map(str.isalpha, text)) < n and nw > 9:
        return "junk"
    if nw >= 3 and n - len(sk) - nw + 1 >= 0.4 * nw and sum(map(text.count, _DIGITS)) >= 0.4 * nw and _random(words):
        return "junk"
    if nw <= 7 and _SLOGAN.match(text):
        return "slogan"
    if nw <= 6 and _CODE_END.search(text) or nw <= 9 and _EXTENSION.match(text):
        return "list"
    if nw <= 7 and _PLACE_ITEM.match(text):
        return "list"
    if nw > 6 and text.count(",") >= 0.3 * nw:
        return "list"
    return "prose" if nw >= 5 and (n > 90 or ends_sentence(text)) else "head"
