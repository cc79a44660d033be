"""Where sequences have given words: a lookup of all windows by their codes, of which what is found goes on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.ragged import byte_slices, strings
from .fixed import on_workers
from .superkmers import _CODE, _TURNED, _mixed, _packed

#: Words of up to so many letters are looked up by their codes, longer ones by hashes of so many bits.
EXACT, BITS = 11, 22


def _slots(code: np.ndarray, size: int) -> np.ndarray:
    return code if size <= EXACT else _mixed(code) >> np.uint64(64 - BITS)


def codes(words: list[str]) -> dict[int, np.ndarray]:
    """The codes of words of the letters ACGT, by their number of letters."""
    by_size: dict[int, list[str]] = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    return {n: _packed(_CODE[np.frombuffer("".join(some).encode(), np.uint8)], n)[::n] for n, some in sorted(by_size.items())}


def spots(seqs: DataFrame, words: dict[int, np.ndarray], most: int, once: bool, stranded: bool) -> DataFrame:
    """(inside, _begin, _window) of the windows of ``seqs`` (inside, sequence; letters ACGT only) that begin with one of ``words``
    (longer ones: maybe), with up to ``most`` letters.  ``once``: a word, or it and its reverse complement unless stranded, comes once
    for each row.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for size, code in words.items():
            tables[size] = np.zeros(1 << (2 * size if size <= EXACT else BITS), bool)
            tables[size][_slots(code, size)] = True
        for batch in batches:
            for first, data, offsets in byte_slices(batch.column(1)):
                n, owner = len(data), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                end = offsets[1:][owner]
                for size, table in tables.items():
                    if n < size:
                        continue
                    code = _packed(_CODE[data], size)[: n - size + 1]
                    at = np.flatnonzero(table[_slots(code, size)] & (np.arange(n - size + 1) + size <= end[: n - size + 1]))
                    if once:
                        kind = code[at]
                        if not stranded:
                            kind = np.minimum(kind, _packed(_TURNED[data][::-1], size)[: n - size + 1][::-1][at])
                        at = at[np.unique(owner[at].astype(np.uint64) << np.uint64(2 * size) | kind, return_index=True)[1]]
                    length = np.full(len(at), size)
                    rows = batch.column(0).take(pa.array(first + owner[at]))
                    columns = [rows, strings(data, at, length), strings(data, at, length if once else np.minimum(most, end[at] - at))]
                    yield pa.RecordBatch.from_arrays(columns, ["inside", "_begin", "_window"])

    kind = seqs.schema["inside"].dataType.simpleString()
    return on_workers(seqs).select("inside", "sequence").mapInArrow(look, f"inside {kind}, _begin string, _window string")
