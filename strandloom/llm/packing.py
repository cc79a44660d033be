"""Packing of tokenised documents into sequences: bounded-space online best-fit.

Each task streams over its rows and holds a fixed number of open bins in a bitset keyed by free
space: bit ``f`` is set while some open bin has ``f`` places free.  A piece goes to the open bin
that it leaves fullest; where none has room a new bin opens, and when too many are open the
fullest closes first.  Where a piece lies is known at once, so rows go out as they come and
memory stays bounded.  Within each Arrow batch the longest pieces go first.

Bins end with their task, and the last ones are partly empty.  So a second, smaller round packs
the sequences that could still share one, as wholes: it sees their fills only, some thousands of them a task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import BROADCAST_KEYS, on_workers, smaller, written

SCHEMA = (
    "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
)


#: Sequences that one task of the second round packs, on average.
REST = 20_000


class OpenBins:
    """At most ``limit`` open bins of ``capacity`` places."""

    def __init__(self, capacity: int, limit: int, first_id: int = 0):
        self.capacity, self.limit, self.next_id = capacity, limit, first_id
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = self.open = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of that length."""
        fits = self.mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(room)
        else:
            if self.open == self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            room, bin_id = self.capacity, self.next_id
            self.next_id += 1
        left = room - length
        if left:
            self.free[left].append(bin_id)
            self.mask |= 1 << left
            self.open += 1
        return bin_id, self.capacity - room

    def _take(self, room: int) -> int:
        bin_id = self.free[room].pop()
        if not self.free[room]:
            self.mask &= ~(1 << room)
        self.open -= 1
        return bin_id


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    capacity: int = 2048,
    end_id: int = 0,
    open_bins: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its token ids and ``end_id``.  Only one that is longer than ``capacity`` is
    cut, into pieces of ``capacity`` and a rest.  A null or empty text is just ``end_id``.  Rows
    with null or repeated ids are documents of their own.  Other columns are ignored; an empty
    table gives no rows.  In the first round sequences belong to one task; their ids hold its partition, so a task
    that runs again gives the same rows.  Its rows are a written table that the result reads, and texts
    are never shuffled.
    """
    source = on_workers(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.load(tokenizer_path)
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 33)
        tail = np.array([end_id], "<u4")
        for batch in smaller(batches, 2000):
            doc, piece, start, length, crc, all_ids = [], [], [], [], [], []
            for first, counts, ids in words.encode(batch.column(1).to_pylist()):
                ids = ids.astype("<u4")
                at = 0
                for i, n in enumerate(counts.tolist()):
                    own = np.concatenate((ids[at : at + n], tail))
                    at += n
                    for k, s in enumerate(range(0, n + 1, capacity)):
                        part = own[s : s + capacity]
                        doc.append(first + i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            all_ids.append(part)
            bin_of, offset = [0] * len(doc), [0] * len(doc)
            for i in sorted(range(len(doc)), key=length.__getitem__, reverse=True):
                bin_of[i], offset[i] = bins.place(length[i])
            columns = [
                batch.column(0).take(pa.array(doc, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc, bin_of, offset)),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([x.tolist() for x in all_ids], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, {SCHEMA}" + ", ids array<long>" * with_ids
    return _merged(written(source.mapInArrow(run, schema), "pieces"), capacity)


def _merged(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` after sequences that fit together have become one."""
    fills = pieces.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    least = fills.agg(F.min("fill")).first()[0]
    if least is None:
        return pieces
    # what doesn't fit with the emptiest one fits with none
    rest = fills.filter(F.col("fill") <= capacity - least)
    parts = max(1, math.ceil(rest.count() / REST))

    def repack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((f, i) for b in batches for i, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), reverse=True)
        bins, first, out = OpenBins(capacity, len(rows)), {}, []
        for fill, own in rows:
            bin_id, offset = bins.place(fill)
            if offset:
                out.append((own, first[bin_id], offset))
            else:
                first[bin_id] = own
        columns = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["sequence_id", "into", "behind"])

    moved = written(rest.repartition(parts, "sequence_id").mapInArrow(repack, "sequence_id long, into long, behind long"), "moved")
    few = moved.count() <= BROADCAST_KEYS
    joined = pieces.join(F.broadcast(moved) if few else moved, "sequence_id", "left")
    place = {"sequence_id": F.coalesce("into", "sequence_id"), "offset": F.col("offset") + F.coalesce("behind", F.lit(0))}
    return joined.withColumns(place).select(*pieces.columns)
