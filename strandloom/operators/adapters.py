"""Adapters at the ends of reads: found from mates, found from what ends repeat, and cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.ragged import byte_slices
from .fixed import on_workers

#: Reads that are compared at a time.
TOGETHER = 4096
_CODE, _KNOWN, _TURNED = np.zeros(256, np.uint64), np.zeros(256, bool), np.arange(256).astype(np.uint8)
for _i, (_b, _c) in enumerate(zip(b"ACGT", b"TGCA", strict=True)):
    _CODE[_b], _KNOWN[_b], _TURNED[_b] = _i, True, _c


def _matrix(data: np.ndarray, offsets: np.ndarray, width: int, turned: bool) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of bytes (reverse complements if ``turned``), filled up with zeros, and their lengths."""
    size = np.diff(offsets)
    place = np.arange(width)
    at = offsets[1:, None] - 1 - place if turned else offsets[:-1, None] + place
    inside = place < size[:, None]
    rows = data[np.where(inside, at, 0)] if len(data) else np.zeros((len(size), width), np.uint8)
    rows = _TURNED[rows] if turned else rows
    return np.where(inside, rows, 0).astype(np.uint8), size


def _bits(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 bases a word, the first in the lowest bit: both bits of the base's code, and whether it is A, C, G or T."""
    code, known = _CODE[rows], _KNOWN[rows]
    words = rows.shape[1] // 64
    place = np.uint64(1) << np.arange(64, dtype=np.uint64)
    fold = lambda bit: (bit.reshape(len(rows), words, 64).astype(np.uint64) * place).sum(2, dtype=np.uint64)
    return np.stack([fold(code & np.uint64(1)), fold(code >> np.uint64(1))]), fold(known)


def _moved(words: np.ndarray, by: int) -> np.ndarray:
    """Bases from ``by`` on, at the front."""
    whole, part = divmod(by, 64)
    out = np.zeros_like(words)
    n = words.shape[-1]
    out[..., : n - whole] = words[..., whole:]
    if part:
        out = out >> np.uint64(part)
        out[..., : n - whole - 1] |= words[..., whole + 1 :] << np.uint64(64 - part)
    return out


def insert_sizes(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], least: int, most: int, share: float) -> np.ndarray:
    """Length of the insert of each pair, or 0.  ``two`` are the reverse complements of the second reads.

    All offsets are looked at; of those where ``least`` bases or more overlap with few enough mismatches the one with the longest overlap
    counts, then the one with fewer mismatches, then the one with the longer insert.
    """
    (a, size_a), (b, size_b) = one, two
    (bits_a, known_a), (bits_b, known_b) = _bits(a), _bits(b)
    best_overlap, best_wrong, best = (np.zeros(len(a), np.int64) for _ in range(3))

    def look(bits_x, known_x, size_x, bits_y, known_y, size_y, by, insert):
        nonlocal best_overlap, best_wrong, best
        overlap = np.minimum(size_x - by, size_y)
        if (overlap < least).all():
            return
        moved = _moved(bits_x, by)
        same = ~((moved[0] ^ bits_y[0]) | (moved[1] ^ bits_y[1])) & _moved(known_x, by) & known_y
        wrong = overlap - np.bitwise_count(same).sum(1)
        good = (overlap >= least) & (wrong <= np.minimum(most, np.floor(share * overlap)))
        better = good & ((overlap > best_overlap) | ((overlap == best_overlap) & ((wrong < best_wrong) | ((wrong == best_wrong) & (insert > best)))))
        best_overlap, best_wrong, best = (np.where(better, new, old) for new, old in ((overlap, best_overlap), (wrong, best_wrong), (insert, best)))

    for by in range(int(size_a.max(initial=0))):  # the second read begins within the first
        look(bits_a, known_a, size_a, bits_b, known_b, size_b, by, by + size_b)
    for by in range(1, int(size_b.max(initial=0))):  # it begins before it: both run into adapters
        look(bits_b, known_b, size_b, bits_a, known_a, size_a, by, size_b - by)
    return best


def with_insert_sizes(pairs: DataFrame, *, least: int = 30, most: int = 5, share: float = 0.2, one: str = "sequence_1", two: str = "sequence_2") -> DataFrame:
    """``pairs`` with insert_size: how long the piece is that both mates were read from; null where they don't overlap.

    Mates overlap if ``least`` bases or more agree but for ``most`` mismatches, and ``share`` of them, at most;
    Ns and null or empty mates agree with nothing.  Comparison is by words of 64 bases.
    """
    source = on_workers(pairs).select("*", F.coalesce(one, F.lit("")).alias("_one"), F.coalesce(two, F.lit("")).alias("_two"))
    names = pairs.columns
    n = len(names)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                sides = []
                for i in (n, n + 1):
                    whole = list(byte_slices(part.column(i), 1 << 62))
                    sides.append(whole[0][1:])
                width = max(64, *(-(-int(np.diff(o).max(initial=0)) // 64) * 64 for _, o in sides))
                found = insert_sizes(_matrix(*sides[0], width, False), _matrix(*sides[1], width, True), least, most, share)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(found.astype(np.int32), mask=found == 0)], [*names, "insert_size"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pairs.schema)
    return source.mapInArrow(measure, f"{kinds}insert_size int")


def trimmed_to_insert(pairs: DataFrame, **options) -> DataFrame:
    """Mates (sequence_1, quality_1, sequence_2, quality_2) cut to their insert where that is shorter than they are."""
    found = with_insert_sizes(pairs, **options)
    cut = {c: F.when(F.col("insert_size") < F.length(c), F.left(c, "insert_size")).otherwise(F.col(c)) for c in pairs.columns if c in ("sequence_1", "sequence_2", "quality_1", "quality_2")}
    return found.withColumns(cut)


def infer_adapter(reads: DataFrame, *, k: int = 12, tail: int = 60, share: float = 0.002, keep: float = 0.5) -> str | None:
    """The sequence that ends of reads repeat, or none.

    The k-mers of the last ``tail`` bases are counted over all reads; what reaches the driver are those
    that more than ``share`` of the reads have (at most tail / share of them).  The most frequent one that isn't made of one or two bases
    only is extended base by base, in both directions, as long as one base goes on in at least ``keep`` of the cases.
    """
    ends = reads.select(F.right("sequence", F.lit(tail)).alias("sequence"))
    counts = ends.select(F.explode(F.array_distinct(S.kmers("sequence", k))).alias("kmer")).filter(~F.col("kmer").rlike("[^ACGT]")).groupBy("kmer").agg(F.count("*").alias("n"))
    total = reads.count()
    often = {r["kmer"]: r["n"] for r in counts.filter(F.col("n") > share * total).collect()}
    seeds = [w for w in often if len(set(w)) > 2]
    if not seeds:
        return None
    found = min(seeds, key=lambda w: (-often[w], w))
    used = {found}
    for forward in (True, False):
        now = found[-k:] if forward else found[:k]
        while True:
            near = [now[1:] + b if forward else b + now[:-1] for b in "ACGT"]
            best = min(near, key=lambda w: (-often.get(w, 0), w))
            if best in used or often.get(best, 0) < keep * often[now]:
                break
            used.add(best)
            now, found = best, found + best[-1] if forward else best[0] + found
    return found


def adapter_places(rows: np.ndarray, size: np.ndarray, adapter: np.ndarray, least: int, share: float) -> np.ndarray:
    """Where the adapter begins in each read: the first place from which all bases to the end of either agree but for ``share`` of them."""
    width = rows.shape[1]
    wrong = np.zeros(rows.shape, np.int16)
    place = np.arange(width)
    for j, b in enumerate(adapter[:width].tolist()):
        other = np.ones(rows.shape, bool)
        other[:, : width - j] = rows[:, j:] != b
        wrong += other & (place + j < size[:, None])
    overlap = np.minimum(size[:, None] - place, len(adapter))
    good = (overlap >= least) & (wrong <= np.floor(share * overlap))
    return np.where(good.any(1), good.argmax(1), size)


def without_adapter(reads: DataFrame, adapter: str, *, least: int = 6, share: float = 0.1) -> DataFrame:
    """Reads (sequence, quality and more) cut where ``adapter`` begins, whole or its first ``least`` bases or more at the end of the read.

    One mismatch is allowed in each 1 / ``share`` bases that overlap; the first such place counts.
    """
    if not adapter:
        return reads
    names, wanted = reads.columns, np.frombuffer(adapter.encode(), np.uint8)
    n = len(names)
    source = on_workers(reads).select("*", F.coalesce("sequence", F.lit("")).alias("_seq"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                _, data, offsets = next(iter(byte_slices(part.column(n), 1 << 62)))
                rows, size = _matrix(data, offsets, max(1, int(np.diff(offsets).max(initial=0))), False)
                places = adapter_places(rows, size, wanted, least, share)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(places.astype(np.int32))], [*names, "_at"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in reads.schema)
    found = source.mapInArrow(find, f"{kinds}_at int")
    return found.select(*(F.left(c, F.col("_at")).alias(c) if c in ("sequence", "quality") else F.col(c) for c in reads.columns))
