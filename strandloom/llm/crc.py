"""The algebra of CRC-32: checksums of joined pieces from the checksums of the pieces.

A CRC is linear over GF(2): ``crc(a + b) = shift(crc(a), len(b)) ^ crc(b)``, where shifting by n
bytes is a 32 x 32 bit matrix.  Matrices are held as four tables of 256 entries each, so that a
product is four look-ups; there is one for every length below 64, and one for every power of two
from there on.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
#: Lengths below this have a matrix of their own.
SHORT = 64


@lru_cache(1)
def byte_table() -> np.ndarray:
    """The CRC register after each byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1)
    return out


def _tables(columns: np.ndarray) -> np.ndarray:
    """A matrix, given as what it makes of each of the 32 bits, as tables for each of the 4 bytes."""
    out = np.zeros((4, 256), np.uint32)
    for bit in range(8):
        has = (np.arange(256) >> bit & 1).astype(bool)
        out[:, has] ^= columns[bit::8, None]
    return out


def product(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


@lru_cache(1)
def shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """For each length below ``SHORT``, and for SHORT, 2 SHORT, 4 SHORT ... up to 2**40."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    low = []
    for _ in range(SHORT):
        low.append(_tables(bits))
        bits = byte_table()[bits & 255] ^ (bits >> 8)
    high = []
    while SHORT << len(high) <= 1 << 40:
        high.append(_tables(bits))
        bits = product(high[-1], bits)
    return np.array(low), high


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs after as many zero bytes as ``size`` says, each for itself."""
    low, high = shift_tables()
    own = size & (SHORT - 1)
    out = low[own, 0, crc & 255] ^ low[own, 1, crc >> 8 & 255] ^ low[own, 2, crc >> 16 & 255] ^ low[own, 3, crc >> 24]
    left, power = size // SHORT, 0
    while left.any():
        at = np.flatnonzero(left & 1)
        out[at] = product(high[power], out[at])
        left, power = left >> 1, power + 1
    return out


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each piece of an array of bytes: one byte of all pieces at a time, long pieces by zlib."""
    size, table = end - start, byte_table()
    out = np.empty(len(start), np.uint32)
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]])
    few = np.flatnonzero(size <= SHORT)
    few = few[np.argsort(-size[few].astype(np.int8), kind="stable")]
    at, register = start[few], np.full(len(few), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-size[few], -np.arange(SHORT), side="left")  # pieces longer than 0, 1, 2 ...
    for i, n in enumerate(live.tolist()):
        if not n:
            break
        register[:n] = table[(register[:n] ^ data[at[:n] + i]) & 255] ^ (register[:n] >> 8)
    out[few] = ~register
    return out
