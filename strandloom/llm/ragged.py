"""Texts as numpy arrays of UTF-8 bytes, straight from Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are worked off at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 22


def byte_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets): text i of the slice is bytes[offsets[i]:offsets[i + 1]].  No nulls."""
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    _, places, held = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(texts):
        stop = int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1
        stop = min(max(stop, begin + 1), len(texts))
        yield begin, data[offsets[begin] : offsets[stop]], offsets[begin : stop + 1] - offsets[begin]
        begin = stop


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + size], one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - size), size) + np.arange(total)]
