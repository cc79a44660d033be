"""Texts as arrays of code points, with vectorised words and rolling hashes.

A slice holds some texts one after the other, each followed by one space.  All arrays of a slice
stay small however many rows a batch has; a single very long text is a slice of its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .bpe import LETTER, NUMBER, OTHER, SPACE, SPACES, powers

SLICE = 200_000


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower case (where it is one character) and whether upper case, of every code point."""
    n = 0x110000
    kind = np.full(n, OTHER, np.uint8)
    low = np.arange(n, dtype=np.uint32)
    upper = np.zeros(n, bool)
    for c in range(0x323B0):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat[0] == "L":
            kind[c] = LETTER
            upper[c] = cat == "Lu"
            if len(small := ch.lower()) == 1:
                low[c] = ord(small)
        elif cat[0] == "N":
            kind[c] = NUMBER
    kind[SPACES] = SPACE
    return kind, low, upper


class Slice:
    """Texts first .. first + len(begin) - 1; text i is chars[begin[i]:end[i]]."""

    def __init__(self, first: int, texts: list[str]):
        self.first = first
        joined = " ".join(texts) + " "
        self.chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(lengths + 1) - 1
        self.begin = self.end - lengths

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, places, side="right")

    def sums(self, per_char: np.ndarray) -> np.ndarray:
        """Sum over each text of a value per character."""
        total = np.r_[0, np.cumsum(per_char, dtype=np.float64)]
        return total[self.end] - total[self.begin]


def slices(texts: list[str | None], size: int = SLICE) -> Iterator[Slice]:
    begin = 0
    while begin < len(texts):
        stop, total = begin, 0
        while stop < len(texts) and (stop == begin or total + len(texts[stop] or "") < size):
            total += len(texts[stop] or "") + 1
            stop += 1
        yield Slice(begin, [t or "" for t in texts[begin:stop]])
        begin = stop


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].view(np.int8)))
    return edge[::2], edge[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (public domain constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of any pieces of an array of code points."""

    def __init__(self, chars: np.ndarray):
        base, self.inverse = powers(1 << max(19, int(len(chars) + 2).bit_length()))
        with np.errstate(over="ignore"):
            value = mix(chars.astype(np.uint64) + np.uint64(0x1234567))
            self.total = np.zeros(len(chars) + 1, np.uint64)
            np.cumsum(value * base[: len(chars)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[end] - self.total[start]) * self.inverse[start])


def hash_of(text: str) -> int:
    """The hash that ``Hasher`` gives this text."""
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return int(Hasher(chars)(np.array([0]), np.array([len(chars)]))[0])
