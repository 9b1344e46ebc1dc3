"""Hashed text features: word n-grams, skip-grams and word shapes as indices of one weight vector."""

from __future__ import annotations

import re
import sys
import types
from collections import Counter
from collections.abc import Callable
from operator import eq

import numpy as np
import xxhash

#: Odd multipliers that tell the kinds of pairs apart.
_MIX = np.array([[0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], [0x165667B19E3779F9, 0x27D4EB2F165667C5], [0xD6E8FEB86659FD93, 0xA0761D6478BD642F]], dtype=np.uint64)
_LAST = np.uint64(0xFF51AFD7ED558CCD)
_KEPT = 120_000
HEADS = (4, 5)
_WORD = re.compile(r"\w+")


def shared(owner: str, name: str, make: Callable[[], object]) -> object:
    """The worker process's table of a name: Python workers serve many tasks, and what one has learned helps the next. Tables of other owners go, so memory doesn't add up over the stages of a job."""
    store = sys.modules.setdefault("termloom_kept", types.ModuleType("termloom_kept")).__dict__
    if store.get("owner") != owner:
        store.clear()
        store["owner"] = owner
    if name not in store:
        store[name] = make()
    return store[name]


def trim(table: dict, most: int) -> None:
    """Of a table of more than most entries keep the first third: frequent words came first."""
    if len(table) > most:
        for key in list(table)[most // 3 :]:
            del table[key]


class WordHashes(dict):
    """64-bit hashes of words and of their first HEADS letters, kept for those seen; call ``trim`` between texts.

    Heads let a model learn a stem from few of its inflected forms. A word not longer than a head repeats its own hash.
    """

    def __init__(self) -> None:
        self.table = np.zeros((1024, 1 + len(HEADS)), dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        if row == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        own = xxhash.xxh64_intdigest(word)
        self.table[row] = [own, *(xxhash.xxh64_intdigest(word[:n] + "\x00") if len(word) > n else own for n in HEADS)]
        return row

    def of(self, words: list[str]) -> np.ndarray:
        """A row for each word: its hash and those of its heads."""
        rows = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return self.table[rows]

    def trim(self) -> None:
        trim(self, _KEPT)


def _indices(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * _LAST) >> np.uint64(64 - bits)).astype(np.int32)


def _distinct(found: np.ndarray) -> np.ndarray:
    """Sorted distinct values of an array, which is sorted in place."""
    found.sort()
    keep = np.ones(len(found), dtype=bool)
    np.not_equal(found[1:], found[:-1], out=keep[1:])
    return found[keep]


def gram_indices(text: str | None, bits: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct indices of the words and their heads, their bigrams and the pairs that skip one or two words."""
    both = hashes.of(_WORD.findall((text or "").lower()))
    h = both[:, 0]
    pairs = [h[:-gap] * _MIX[gap - 1, 0] + h[gap:] * _MIX[gap - 1, 1] for gap in (1, 2, 3) if len(h) > gap]
    hashes.trim()
    return _distinct(_indices(np.concatenate([both.ravel(), *pairs]), bits))


#: ASCII codes by class, and one for all others: 0 white space, 1 letters and digits, 2 capitals, 3 the rest.
_CLASS = np.array([0 if chr(c).isspace() else 2 if chr(c).isupper() else 1 if chr(c).isalnum() else 3 for c in range(128)] + [1])
#: Code points from here on have no class of their own in shapes.
_LAST_LETTER = 0x323B0


def shape_table() -> np.ndarray:
    """What each code point is in the shape of a word: letters a or A, digits 0, white space a blank, others themselves."""
    table = np.arange(_LAST_LETTER, dtype=np.uint32)
    for n in range(_LAST_LETTER):
        c = chr(n)
        if c.isspace():
            table[n] = 32
        elif c in "0123456789":
            table[n] = 48
        elif c.isalnum() and not c.isdecimal():
            table[n] = 65 if c.isupper() else 97
    return table


def word_shapes(codes: np.ndarray, table: np.ndarray) -> dict[str, int]:
    """The shapes of a text's words, runs as one, with their numbers; codes: its code points."""
    of = table[np.minimum(codes, _LAST_LETTER - 1)]
    of = np.where(codes < _LAST_LETTER, of, codes)
    first = np.concatenate(([True], of[1:] != of[:-1]))[: len(of)]
    return Counter(of[first].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split())


def _share(part: int, whole: int) -> int:
    """0 for none, then one step for each doubling of the share up to 8 for all."""
    return 0 if not part else max(1, 8 + int(np.floor(np.log2(part / whole))))


def style_indices(text: str | None, bits: int, hashes: WordHashes, table: np.ndarray) -> np.ndarray:
    """Indices of what a text looks like (table: shape_table()): shares of its word shapes, repeated lines and words, length."""
    words = (text or "").split()
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    seen = word_shapes(codes, table)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    names = [f"s{_share(n, len(words))}{s}" if len(s) <= 64 else f"s{_share(n, len(words))}{s[:8]}{xxhash.xxh64_hexdigest(s)}" for s, n in seen.items()]
    names += [f"w{int(8 * len(set(words)) / len(words))}", f"r{_share(sum(map(eq, words, words[1:])), len(words))}"] if words else ["empty"]
    names += [f"l{int(8 * len(set(lines)) / len(lines))}", f"m{min(8, int(np.log2(len(lines))))}"] if lines else []
    names.append(f"n{int(np.log2(len(words) + 1))}")
    blank, letter, upper, other = np.bincount(_CLASS[np.minimum(codes, 128)], minlength=4).tolist()
    names.append(f"u{8 * upper // max(1, letter + upper)}")
    names.append(f"p{16 * other // max(1, letter + upper + other)}")
    hashes.trim()
    return _distinct(_indices(hashes.of(names)[:, 0], bits))
