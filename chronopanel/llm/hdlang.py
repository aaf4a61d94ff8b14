"""Hyperdimensional language profiles.

Each letter has a random vector of +1 and -1. A trigram's vector is the product of its letters' vectors, permuted (rotated) twice, once and
not at all. A text's vector is the sum (bundle) of its trigrams' vectors; a language's prototype is that of its labelled texts. Texts and
prototypes are compared by cosine. As the product with a prototype is linear in the trigrams, ``<trigram, prototype>`` is tabled once
(alphabet cubed x languages, a fixed size) and a text's products are sums of table rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# The letters that are told apart by themselves; what is no letter counts as a gap between words.
ALPHABET = "abcdefghijklmnopqrstuvwxyzäöüßéèêàâçñáíóúùûôîïëœæåãìò"
#: Classes into which all other letters of Unicode are hashed. Their trigrams hardly occur in Latin prototypes, so their cosines stay near 0.
OTHERS = 3
SIZE = len(ALPHABET) + 1 + OTHERS
CELLS = SIZE**3
DIMENSIONS = 2048


def _codes() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x32000):
        if chr(c).isalpha():
            table[c] = len(ALPHABET) + 1 + ord(chr(c).lower()[0]) % OTHERS
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i + 1
        if len(c.upper()) == 1:
            table[ord(c.upper())] = i + 1
    return table


CODES = _codes()


def cells(text: str) -> np.ndarray:
    """Trigram numbers of a text, gaps collapsed; a trigram of gaps only, or around a lone gap in the middle, is left out."""
    code = CODES[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int32)
    code = code[np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))]
    if len(code) < 3:
        return np.zeros(0, dtype=np.int32)
    return ((code[:-2] * SIZE + code[1:-1]) * SIZE + code[2:])[code[1:-1] != 0]


class Profiles(NamedTuple):
    """Languages, and the product of each trigram's vector with each centred, normed prototype."""

    langs: tuple[str, ...]
    table: np.ndarray  # CELLS x languages, float32

    def cosines(self, text: str) -> np.ndarray:
        """Cosine of a text with every prototype; zeros for a text without letters. The text's norm is taken as that of nearly orthogonal trigrams."""
        at = cells(text)
        if not len(at):
            return np.zeros(len(self.langs), dtype=np.float32)
        _, count = np.unique(at, return_counts=True)
        return self.table[at].sum(axis=0) / (np.sqrt(float((count.astype(np.float64) ** 2).sum())) * np.sqrt(DIMENSIONS))

    def sums(self, texts: list[str], norms: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Products of every text's vector with every prototype, one row each, and if ``norms`` each text's sum of squared trigram counts."""
        out, square = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        padded = [f" {t} " for t in texts]
        code = CODES[np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int32)
        of = np.repeat(np.arange(len(texts)), [len(t) for t in padded])
        if not len(code):
            return out, square
        keep = np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))
        code, of = code[keep], of[keep]
        mid = np.flatnonzero(code[1:-1] != 0) + 1
        if not len(mid):
            return out, square
        at, of = (code[mid - 1] * SIZE + code[mid]) * SIZE + code[mid + 1], of[mid]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        out[of[first]] = np.add.reduceat(self.table.take(at, axis=0), first, axis=0)
        if norms:
            key = np.sort(of.astype(np.int64) * CELLS + at)
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            square = np.bincount(key[start] // CELLS, weights=np.diff(np.append(start, len(key))).astype(float) ** 2, minlength=len(texts))
        return out, square

    def each(self, texts: list[str]) -> np.ndarray:
        """:meth:`cosines` of every text at once, one row each."""
        dots, square = self.sums(texts, norms=True)
        return dots / np.sqrt(np.maximum(square, 1.0) * DIMENSIONS)[:, None]

    def nearest(self, text: str) -> str | None:
        """Language with the greatest cosine, for which the text's norm doesn't matter; null for a text without letters."""
        at = cells(text)
        return self.langs[int(self.table[at].sum(axis=0).argmax())] if len(at) and self.langs else None


def train(counts: dict[str, np.ndarray], seed: int = 6) -> Profiles:
    """Profiles from trigram counts (one array of CELLS for each language). Languages without a count are left out."""
    langs = tuple(sorted(k for k, v in counts.items() if v.sum() > 0))
    rng = np.random.default_rng(seed)
    letters = rng.choice(np.array([-1, 1], dtype=np.int8), size=(SIZE, DIMENSIONS))
    letters = letters.astype(np.float32)
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    weight = np.stack([counts[k] / counts[k].sum() for k in langs]).astype(np.float32).reshape(len(langs), SIZE, SIZE, SIZE) if langs else np.zeros((0, SIZE, SIZE, SIZE), np.float32)
    # sums and products over trigrams, taken apart by their letters, so that no trigram's vector is ever formed
    proto = np.zeros((len(langs), DIMENSIONS), dtype=np.float32)
    for k in range(len(langs)):
        for a in range(SIZE):
            proto[k] += first[a] * (second * (weight[k, a] @ letters)).sum(axis=0)
    if len(langs) > 1:
        proto -= proto.mean(axis=0)
    proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9)
    table = np.zeros((SIZE, SIZE, SIZE, len(langs)), dtype=np.float32)
    for k in range(len(langs)):
        for a in range(SIZE):
            table[a, :, :, k] = (second * (first[a] * proto[k])) @ letters.T
    return Profiles(langs, table.reshape(CELLS, len(langs)))
