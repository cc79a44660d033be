"""A minimal perfect hash of byte strings, looked up for many pieces of a buffer at once.

Hash and displace: keys fall into buckets, and each bucket gets the first displacement that sends
its keys to places that are still free.  Buckets of one key take what is left over directly, so
there are exactly as many places as keys.  A place holds its key in words of eight bytes, so a hit
is confirmed on all of its bytes.
"""

from __future__ import annotations

import numpy as np

from .chars import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Keys of a bucket on average, and displacements tried at a time.
BUCKET, TRIES = 4, 64


def padded(data: bytes | np.ndarray, size: int) -> np.ndarray:
    """The eight bytes from every place of a buffer, as little-endian words; ``size`` bytes may be read from any."""
    held = np.concatenate([np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data, np.zeros(size + 8, np.uint8)])
    return np.ndarray((len(held) - 7,), "<u8", held, 0, (1,))


def hashes(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece (no longer than what ``padded`` allows) of a buffer."""
    with np.errstate(over="ignore"):
        out = mix((words[start] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * _STEP)
        at, i = np.flatnonzero(size > 8), 1
        while len(at):
            out[at] = mix(out[at] * _STEP ^ words[start[at] + 8 * i] & _MASKS[np.minimum(size[at] - 8 * i, 8)])
            i += 1
            at = at[size[at] > 8 * i]
    return out


def same_bytes(words: np.ndarray, start: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether pieces of one buffer equal others of the same size."""
    out, i = np.ones(len(start), bool), 0
    while len(at := np.flatnonzero(size > 8 * i)):
        differ = (words[start[at] + 8 * i] ^ words[other[at] + 8 * i]) & _MASKS[np.minimum(size[at] - 8 * i, 8)]
        out[at[differ != 0]] = False
        i += 1
    return out


class PerfectHash:
    """Places 0 .. n - 1 of n distinct keys."""

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.longest = max(map(len, keys), default=0)
        sizes = np.fromiter(map(len, keys), np.int64, self.n)
        words = padded(b"".join(keys), self.longest)
        starts = np.cumsum(sizes) - sizes
        code = hashes(words, starts, sizes)
        assert len(np.unique(code)) == self.n, "keys repeat"
        self.buckets = -(-self.n // BUCKET)
        self.shift = np.zeros(self.buckets, np.int64)
        place = self._displace(code)
        self.key_of = np.empty(self.n, np.int64)
        self.key_of[place] = np.arange(self.n)
        order = self.key_of
        self.size = sizes[order]
        self.words = np.zeros((-(-self.longest // 8), self.n), np.uint64)
        for i, row in enumerate(self.words):
            some = self.size > 8 * i
            row[some] = words[starts[order[some]] + 8 * i] & _MASKS[np.minimum(self.size[some] - 8 * i, 8)]

    def _displace(self, code: np.ndarray) -> np.ndarray:
        bucket = (code % np.uint64(self.buckets)).astype(np.int64)
        members = np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=self.buckets))[:-1])
        free, place = np.ones(self.n, bool), np.empty(self.n, np.int64)
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if len(own) < 2:
                break
            first = 0
            while True:
                at = self._places(code[own][:, None], np.arange(first, first + TRIES))
                fits = free[at].all(0)
                for c in np.flatnonzero(fits).tolist():
                    if len(set(at[:, c].tolist())) == len(own):
                        break
                else:
                    first += TRIES
                    continue
                break
            self.shift[b], place[own] = first + c, at[:, c]
            free[at[:, c]] = False
        lone = [own[0] for own in members if len(own) == 1]
        place[lone] = np.flatnonzero(free)
        self.shift[bucket[lone]] = -1 - place[lone]
        return place

    def _places(self, code: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(code + (shift.astype(np.uint64) + np.uint64(1)) * _STEP) % np.uint64(self.n)).astype(np.int64)

    def find(self, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of the key that each piece is, or -1.  ``words`` is ``padded`` for ``longest`` bytes."""
        out = np.full(len(start), -1, np.int64)
        able = np.flatnonzero((size <= self.longest) & (size > 0))
        if not len(able) or not self.n:
            return out
        start, size = start[able], size[able]
        code = hashes(words, start, size)
        shift = self.shift[(code % np.uint64(self.buckets)).astype(np.int64)]
        place = np.where(shift < 0, -1 - shift, self._places(code, shift))
        same = self.size[place] == size
        for i, row in enumerate(self.words):
            at = np.flatnonzero(same & (size > 8 * i))
            same[at] = row[place[at]] == words[start[at] + 8 * i] & _MASKS[np.minimum(size[at] - 8 * i, 8)]
        out[able[same]] = self.key_of[place[same]]
        return out
