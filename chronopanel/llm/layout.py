"""Body and chrome of pages by minimum cut, with costs fitted to the site's own repetition.

Each line is a node. Its terminal capacities are the log-odds of four features: its kind, how often its site repeats it (by length),
its place on the page, and whether it repeats the page's title. Two of them start from votes: what a kind of :mod:`pagelines` says about a
line, and that whole sentences which recur in many texts of a site belong to the site. Expectation maximisation over counts of all lines
fits all four; kind and repetition may move from their votes by at most ``SWING``, so rare kinds don't drift. Neighbours are joined by edges: lines
of a block that are alike, other neighbours in a block, and neighbours across an empty line. Blocks of lines stand for nearness in the document tree, which the
tables don't hold. Edge weights are half the log odds ratio of neighbours' labels. The cut of least cost then decides.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from . import lexicon as lx
from . import pagelines as pl
from .mincut import label

#: Kinds as they count here: a notice beside other content is told from one that is alone.
KINDS = (*pl.KINDS, "notice+", "script+")
CODE = {k: i for i, k in enumerate(KINDS)}
#: Words of other content that make a notice one beside it.
REAL_WORDS = 5
#: Length classes of lines in characters.
LENGTHS = (12, 40)
#: A line that stands in ``OFTEN`` texts of its site or more has repetition level 3; in fewer, but at least two and at least ``SHARE`` of the site's texts, 2; in several, 1, as
#: a sentence may be used again in a few bodies of a large site; in one, 0.
OFTEN, SHARE = 8, 0.18
#: Kinds that repeat for reasons of their own.
OWN_REASONS = ("list", "table", "junk", "notice", "filler", "script")
#: Probability of chrome that a kind votes for.
VOTES = {
    **dict.fromkeys(("menu", "trail", "teaser", "dated", "footer", "phone", "address", *lx.PROMPTS, "script+"), 0.97),
    "slogan": 0.8, "notice+": 0.9, "head": 0.2, **dict.fromkeys(("prose", "list", "table", "junk", "notice", "filler", "script"), 0.03),
}
#: Log-odds that repetition votes for, by length class and level.
REPEAT_VOTES = ((-0.5, 0.0, 0.0, 1.0), (-0.5, 0.0, 1.0, 6.0), (-0.5, 0.0, 4.0, 6.0))
#: How far a fitted cost may move from its vote, largest cost of place and title, rounds of fitting, lines that count as seen before any is, largest weight of an edge.
SWING, CLIP, ROUNDS, SEEN, EDGE = 1.0, 4.0, 12, 5.0, 2.5
SHAPE = (len(KINDS), 24, 6, 2)
SAME, NEXT, GAP = range(3)


class Lines(NamedTuple):
    """The non-empty lines of some pages, flat and in order. ``of`` counts pages from 0 and rises; ``alike`` and ``edge`` describe each line and the one before it."""

    of: np.ndarray
    cell: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    edge: np.ndarray  # type of the edge to the line before; -1 for a page's first line


class Costs(NamedTuple):
    """Fitted log-odds of each feature's values (positive: chrome), and weights of the three types of edges."""

    kind: np.ndarray
    repeat: np.ndarray
    place: np.ndarray
    own: np.ndarray
    edges: np.ndarray


def _votes() -> tuple[np.ndarray, np.ndarray]:
    p = np.array([VOTES.get(k, 0.5) for k in KINDS])
    plain = np.array(REPEAT_VOTES).ravel()
    return np.log(p / (1 - p)), np.concatenate((plain, np.zeros(12)))


KIND_VOTES, REPETITION_VOTES = _votes()
_REASON = np.isin(np.arange(len(KINDS)), [CODE[k] for k in OWN_REASONS])
_CONTENT = np.isin(np.arange(len(KINDS)), [CODE[k] for k in ("prose", "list", "table", "junk")])


def prior() -> Costs:
    """Costs from the votes alone, for pages without a corpus."""
    return Costs(KIND_VOTES, REPETITION_VOTES, np.zeros(6), np.array([0.0, -3.0]), np.array([EDGE, 0.8, 0.0]))


def describe(of: np.ndarray, no: np.ndarray, kind: np.ndarray, words: np.ndarray, size: np.ndarray, own: np.ndarray, level: np.ndarray) -> Lines:
    """Features of lines: page, number in the page, kind, words, length class, whether it repeats the title, and repetition level."""
    n = len(of)
    pages = int(of[-1]) + 1 if n else 0
    first = np.concatenate(([True], of[1:] != of[:-1])) if n else np.zeros(0, bool)
    count = np.bincount(of, minlength=pages)
    order = np.arange(n) - np.repeat(np.flatnonzero(first), count[count > 0])
    total = count[of]
    place = np.select([total == 1, order == 0, order == total - 1, order <= 2, order >= total - 3], [5, 0, 4, 1, 3], 2)
    reason = _REASON[kind]
    real = np.bincount(of, weights=words * (_CONTENT[kind] & ((level < 2) | reason)), minlength=pages)[of] >= REAL_WORDS
    filler = np.bincount(of, weights=kind == CODE["filler"], minlength=pages)[of] > 0
    kind = np.where((kind == CODE["notice"]) & real, CODE["notice+"], np.where((kind == CODE["script"]) & (real | filler), CODE["script+"], kind))
    alike = kind * 2 + (level > 1)
    edge = np.full(n, -1)
    if n:
        inner = np.flatnonzero(~first)
        edge[inner] = np.where(no[inner] - no[inner - 1] > 1, GAP, np.where(alike[inner] == alike[inner - 1], SAME, NEXT))
    return Lines(of, (kind, reason * 12 + size * 4 + level, place, own.astype(np.int64)), edge)


def tally(x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Counts of feature combinations (flat over ``SHAPE``), and of neighbours' votes by type of edge (type, before, after)."""
    cells = np.bincount(np.ravel_multi_index(x.cell, SHAPE), minlength=int(np.prod(SHAPE))) if len(x.of) else np.zeros(int(np.prod(SHAPE)), np.int64)
    z = (KIND_VOTES[x.cell[0]] + REPETITION_VOTES[x.cell[1]] > 0).astype(np.int64)
    at = np.flatnonzero(x.edge >= 0)
    return cells, np.bincount(x.edge[at] * 4 + z[at - 1] * 2 + z[at], minlength=12)


def fit(cells: np.ndarray, pairs: np.ndarray) -> Costs:
    """Costs from the sums of :func:`tally`. Without any line they are the votes."""
    at = np.flatnonzero(cells)
    if not len(at):
        return prior()
    n, index = cells[at].astype(float), np.unravel_index(at, SHAPE)
    votes = (KIND_VOTES, REPETITION_VOTES, None, None)
    q = 1 / (1 + np.exp(-(KIND_VOTES[index[0]] + REPETITION_VOTES[index[1]])))
    tables: list[np.ndarray] = []
    for _ in range(ROUNDS):
        share = float((q * n).sum() / n.sum())
        tables = []
        for values, width, vote in zip(index, SHAPE, votes, strict=True):
            seen = len(np.unique(values))
            yes, no = np.bincount(values, q * n, width) + SEEN * share, np.bincount(values, (1 - q) * n, width) + SEEN * (1 - share)
            cost = np.log(yes / (yes.sum() - (width - seen) * SEEN * share)) - np.log(no / (no.sum() - (width - seen) * SEEN * (1 - share)))
            if vote is KIND_VOTES:
                cost += np.log(share / (1 - share))
            tables.append(np.clip(cost, -CLIP, CLIP) if vote is None else np.clip(cost, vote - SWING, vote + SWING))
        q = 1 / (1 + np.exp(-sum(t[v] for t, v in zip(tables, index, strict=True))))
    p = pairs.reshape(3, 2, 2) + 1.0
    edges = np.clip(0.5 * np.log(p[:, 0, 0] * p[:, 1, 1] / (p[:, 0, 1] * p[:, 1, 0])), 0.0, EDGE)
    return Costs(*tables, edges)


def unary(x: Lines, costs: Costs) -> np.ndarray:
    """Log-odds of chrome of every line by itself."""
    k, r, p, o = x.cell
    return costs.kind[k] + costs.repeat[r] + costs.place[p] + costs.own[o]


def cut(x: Lines, costs: Costs) -> np.ndarray:
    """Whether each line is chrome, by the minimum cut of its page. A line whose cost exceeds the weights of all its edges keeps its side in every
    minimum cut, so only pages with other lines are cut; a tie is body."""
    n = len(x.of)
    odds = unary(x, costs)
    weight = np.where(x.edge >= 0, costs.edges[x.edge], 0.0)
    out = odds > 0
    if not n:
        return out
    bound = weight + np.append(weight[1:], 0.0)
    weak = np.unique(x.of[np.abs(odds) <= bound])
    start, end = np.searchsorted(x.of, weak), np.searchsorted(x.of, weak, side="right")
    for i, j in zip(start.tolist(), end.tolist(), strict=True):
        own = odds[i:j]
        edges = [(k - 1, k, w) for k, w in enumerate(weight[i:j].tolist()) if k and w]
        out[i:j] = np.array(label(np.maximum(own, 0).tolist(), np.maximum(-own, 0).tolist(), edges), dtype=bool)
    return out


class Page(NamedTuple):
    """A page's lines in order, one label each (True: body; None: empty line), and whether its body is only a notice."""

    lines: list[pl.Line]
    body: list[bool | None]
    notice_only: bool


def own_titles(titles: tuple[str | None, ...]) -> set[str]:
    """Titles in the form in which lines are compared with them."""
    return {x for x in (pl.tidy(t) for t in titles if t) if x}


def is_own(x: pl.Line, own: set[str]) -> bool:
    """Whether a line is a title, or its beginning of three words or more."""
    return bool(own) and x.kind in ("head", "slogan", "prose") and any(x.text == t or (x.words >= 3 and t.startswith(x.text)) for t in own)


def size_class(text: str) -> int:
    n = len(text)
    return (n >= LENGTHS[0]) + (n >= LENGTHS[1])


def summary(of: np.ndarray, pages: int, kind: np.ndarray, words: np.ndarray, chrome: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each page: words of its body, words of its body in lists, tables and junk, and whether its body is only a notice or script notice."""
    body = ~chrome
    total = np.bincount(of, weights=words * body, minlength=pages)
    odd = np.bincount(of, weights=words * (body & np.isin(kind, [CODE[k] for k in ("list", "table", "junk")])), minlength=pages)
    plain = np.bincount(of, weights=words * (body & ~np.isin(kind, [CODE[k] for k in ("notice", "filler", "script", "head")])), minlength=pages)
    notice = np.bincount(of, weights=body & np.isin(kind, [CODE["notice"], CODE["script"]]), minlength=pages)
    filler = np.bincount(of, weights=kind == CODE["filler"], minlength=pages)
    return total, odd, (notice > 0) & (plain < REAL_WORDS) & (filler == 0)


def split_page(text: str | None, titles: tuple[str | None, ...] = (), levels: dict[int, int] | None = None, costs: Costs | None = None) -> Page:
    """Label the lines of one page. ``levels``: repetition level of a line by its number (from 1); ``costs``: fitted costs, else the votes.
    Null or empty text gives no lines."""
    lines = [pl.classify(x) for x in (text or "").split("\n")]
    at = np.array([i for i, x in enumerate(lines) if x.kind], dtype=np.int64)
    own = own_titles(titles)
    seen = levels or {}
    column = lambda f: np.array([f(i) for i in at], dtype=np.int64)
    kind, words = column(lambda i: pl.CODE[lines[i].kind]), column(lambda i: lines[i].words)
    x = describe(np.zeros(len(at), np.int64), at, kind, words, column(lambda i: size_class(lines[i].text)), column(lambda i: is_own(lines[i], own)), column(lambda i: seen.get(int(i) + 1, 0)))
    chrome = cut(x, costs or prior())
    mark: list[bool | None] = [None] * len(lines)
    for i, c in zip(at.tolist(), chrome.tolist(), strict=True):
        mark[i] = not c
    return Page(lines, mark, bool(summary(x.of, 1, kind, words, chrome)[2][0]))
