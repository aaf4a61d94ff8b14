"""Unfilled placeholders, default titles, filler and notices in the place of content. Pure Python, no Spark."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING, NamedTuple

from . import lexicon as lx

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from .layout import Page

_NAME = r"[A-Za-z_][\w.\- ]{0,40}?"
#: One grammar for each kind of delimiter; group 1 is the name of the slot.
GRAMMARS = {
    "mustache": rf"\{{\{{\s*({_NAME})\s*\}}\}}",
    "smarty": rf"\{{\$\s*({_NAME})\s*\}}",
    "dollar": rf"\$\{{\s*({_NAME})\s*\}}",
    "hash": rf"#\{{\s*({_NAME})\s*\}}",
    "tag": rf"\{{%-?\s*({_NAME})\s*-?%\}}",
    "asp": rf"<%[=#]?\s*({_NAME})\s*%>",
    "php": r"<\?(?:php|=)\s*(?:echo|print)?\s*\$?([\w.\->\[\]' ]{1,40}?)\s*;?\s*\?>",
    "wiki": rf"\[\[\s*({_NAME})\s*\]\]",
    "marker": rf"###\s*({_NAME})\s*###",
    "at": rf"@@\s*({_NAME})\s*@@",
    "under": r"(?<![\w])__([A-Za-z][A-Za-z_ .]{1,40}?)__(?!\w)",
    "percent": r"(?<![\w%])%([A-Za-z][A-Za-z_.]{1,40})%(?![\w%])",
    "entity": rf"&lt;\s*({_NAME})\s*&gt;",
    "bracket": rf"(?<![\w\[])\[({_NAME})\](?![\w\]])",
    "angle": r"<([a-z]+(?:[_.][a-z]+)+)>",
}
_EACH = {k: re.compile(p) for k, p in GRAMMARS.items()}
#: What a text must contain for a grammar to be tried.
_SIGNS = {
    "mustache": "{{", "smarty": "{$", "dollar": "${", "hash": "#{", "tag": "{%", "asp": "<%", "php": "<?", "wiki": "[[", "marker": "###", "at": "@@", "under": "__",
    "percent": "%", "entity": "&lt;", "bracket": "[", "angle": "<",
}
_INNER = re.compile(r"[A-Za-z][\w.\- ]*[A-Za-z]|[A-Za-z]")
_TITLE = re.compile(lx.EDITOR_TITLE, re.I)
#: Words around a slot that show a text about templates, and the density of slots at which a block is code.
TUTORIAL = re.compile(r"(?:Platzhalter\b|placeholders?\b|espace r.serv.|marcador|segnaposto|plaatshouder|Syntax|syntax|template (?:engine|tag|variable)|Vorlagensprache|Variable\b|variable\b|<code>|```)")
CODE_DENSITY = 0.25
_CODE = re.compile(r"[;{}()=<>$]")


class Residue(NamedTuple):
    """What was found: kind (placeholder, title, filler, notice) and the piece of text."""

    kind: str
    piece: str


def slots(text: str | None) -> list[tuple[str, str, int]]:
    """``(grammar, slot name, position)`` of every unfilled placeholder. A single bracket counts only around the name of a slot."""
    if not text:
        return []
    out = []
    taken: set[int] = set()
    for kind, m in ((k, m) for k, sign in _SIGNS.items() if sign in text for m in _EACH[k].finditer(text)):
        if not taken.isdisjoint(range(m.start(), m.end())):
            continue
        inner = _INNER.search(m.group().replace("&lt;", "").replace("&gt;", "").replace("<?php", "").replace("echo", ""))
        name = inner.group() if inner else ""
        if kind in ("bracket", "percent", "wiki", "entity", "under", "asp", "tag", "mustache", "hash", "at", "marker", "smarty", "dollar", "php", "angle"):
            joint = "_" in name or "." in name
            known = lx.skeleton(name) in lx.SLOT_NAMES
            if kind == "bracket" and not (known or joint or (name.isupper() and len(name) > 2)):
                continue
            if kind in ("percent", "entity", "under") and not (known or joint or name.isupper() and len(name) > 3 or kind == "under"):
                continue
            if not name or kind in ("tag", "mustache", "hash", "dollar", "smarty", "at", "marker", "asp", "wiki") and len(name) < 2:
                continue
        taken.update(range(m.start(), m.end()))
        out.append((kind, name, m.start()))
    return sorted(out, key=lambda x: x[2])


def quoted(text: str, found: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """``found`` without the slots that are shown on purpose: in a text about templates, or in a line that is code by density."""
    keep = []
    for kind, name, at in found:
        start = text.rfind("\n", 0, at) + 1
        end = text.find("\n", at)
        line = text[start : end if end >= 0 else len(text)]
        around = text[max(start, at - 40) : at + 60]
        if TUTORIAL.search(around):
            continue
        rest = line.replace(" ", "")
        here = [n for _, n, p in found if start <= p < start + len(line)]
        inside = sum(len(n) + 6 for n in here)
        if len(rest) - inside > 40 and len(_CODE.findall(line)) - 6 * len(here) > CODE_DENSITY * len(rest):
            continue
        keep.append((kind, name, at))
    return keep


def marks(text: str | None, title: str | None) -> list[Residue]:
    """Placeholders of text and title, and a default title; what a page's lines don't need to be labelled for."""
    out = [Residue("placeholder", f"{k}:{n}") for part in (title, text) if part for k, n, _ in quoted(part, slots(part))]
    if title and _TITLE.fullmatch(title.strip()):
        out.append(Residue("title", title.strip()))
    return out


def find(page: Page, text: str | None, title: str | None) -> list[Residue]:
    """All residue of a page, ``[]`` for none. Null text and title give ``[]``."""
    out = marks(text, title)
    out += [Residue("filler", x.text) for x in page.lines if x.kind == "filler"]
    if page.notice_only:
        out += [Residue("notice", x.text) for x, b in zip(page.lines, page.body, strict=True) if b and x.kind in ("notice", "script")]
    return out


def pieces(labelled: DataFrame) -> DataFrame:
    """Page key, ``kind`` and ``piece`` of all residue of every labelled page, once."""
    from pyspark.sql import functions as F

    from .pages import KEY

    return labelled.select(*KEY, F.explode("residue").alias("r")).select(*KEY, "r.kind", "r.piece").distinct()


def found(labelled: DataFrame) -> DataFrame:
    """Keys of pages with residue, once."""
    from .pages import KEY

    return pieces(labelled).select(*KEY).distinct()
