"""Cleaning of reads: (read_index, header, sequence, quality)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quality as Q
from ..functions import sequence as S
from ..functions.ragged import byte_slices, strings
from .fixed import on_workers


def split_at_n(reads: DataFrame, min_length: int | None = None, prefix: int = 0) -> DataFrame:
    """Pieces of a read between its Ns, as reads ``header:start-end``.

    Places are 0-based and half-open where there are several pieces; one piece is ``1-end``.
    Pieces under ``min_length`` go only where there are several.  The first ``prefix`` bases
    (barcode and UMI) are put before every piece and not split.
    """
    lead = lambda c: F.substring(c, 1, prefix)
    rest = lambda c: F.substring(c, F.lit(prefix + 1), F.length(c))
    others = [c for c in reads.columns if c not in ("header", "sequence", "quality")]
    whole = reads.filter("sequence IS NOT NULL").select(
        *others, "header", lead("sequence").alias("_lead"), lead("quality").alias("_quality_lead"),
        rest("sequence").alias("_piece"), F.coalesce(rest("quality"), F.lit("")).alias("_quality"),
    )
    rows = _pieces(whole)
    if min_length is not None:
        rows = rows.filter((F.col("_n") == 1) | (F.col("_end") - F.col("_at") >= min_length))
    label = F.when(F.col("_n") > 1, F.concat_ws("-", "_at", "_end")).otherwise(F.concat(F.lit("1-"), F.col("_end").cast("string")))
    return rows.select(
        *others,
        F.concat("header", F.lit(":"), label).alias("header"),
        F.concat("_lead", "_piece").alias("sequence"),
        F.concat("_quality_lead", "_quality").alias("quality"),
    )


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, place of each character and of the end, number of the first character of each text and of the end) of texts."""
    _, data, offsets = next(byte_slices(texts, 1 << 62))
    places = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
    return data, places, np.searchsorted(places, offsets)


def _pieces(whole: DataFrame) -> DataFrame:
    """A row for each piece of ``_piece`` between Ns, with the same part of ``_quality``, its places _at and _end and
    the number _n of pieces.  A text is gone through once, however many pieces it has."""
    kept = [c for c in whole.columns if c not in ("_piece", "_quality")]
    schema = T.StructType([*(whole.schema[c] for c in kept), *(T.StructField(c, T.IntegerType()) for c in ("_n", "_at", "_end")), *(T.StructField(c, T.StringType()) for c in ("_piece", "_quality"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, offsets in byte_slices(batch.column("_piece")):
                part = batch.slice(begin, len(offsets) - 1)
                data, places, first = _characters(part.column("_piece"))
                owner = np.repeat(np.arange(part.num_rows), np.diff(first))
                base = ~np.isin(data[places[:-1]], np.frombuffer(b"Nn", np.uint8))
                new = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
                last = np.r_[new[1:], True] if len(owner) else new
                start = np.flatnonzero(base & (new | ~np.r_[False, base[:-1]][: len(base)]))
                stop = np.flatnonzero(base & (last | ~np.r_[base[1:], False][: len(base)])) + 1
                row = owner[start]
                at, end = start - first[row], stop - first[row]
                quality, spots, begins = _characters(part.column("_quality"))
                low, high = (spots[np.minimum(begins[row] + x, begins[row + 1])] for x in (at, end))
                columns = [*(part.column(c).take(pa.array(row)) for c in kept), *(pa.array(x.astype(np.int32)) for x in (np.bincount(row, minlength=1)[row], at, end))]
                yield pa.RecordBatch.from_arrays([*columns, strings(data, places[start], places[stop] - places[start]), strings(quality, low, high - low)], schema.names)

    return on_workers(whole).mapInArrow(cut, schema)


def mask(reads: DataFrame, phred: int) -> DataFrame:
    return reads.withColumn("sequence", Q.mask_low_quality("sequence", "quality", phred))


def quality_control(
    reads: DataFrame, *, min_length: int = 0, max_n: int | None = None, mean_quality: int | None = None, unqualified: tuple[int, float] | None = None,
) -> DataFrame:
    """Reads that are long enough, with few Ns, of good mean quality and with few poor bases."""
    keep = F.length("sequence") >= min_length
    if max_n is not None:
        keep = keep & (S.ambiguous_bases("sequence") <= max_n)
    if mean_quality is not None:
        keep = keep & (F.coalesce(Q.mean_quality("quality"), F.lit(0.0)) >= mean_quality)
    if unqualified is not None:
        keep = keep & (Q.unqualified_share("quality", unqualified[0]) <= unqualified[1])
    return reads.filter(keep)


def with_window_cuts(reads: DataFrame, window: int, mean: int) -> DataFrame:
    """``reads`` with _cut: how many bases are kept when a window slides from the 5' end and the read is cut where its mean
    quality is under ``mean``.  Windows are differences of running sums."""
    source = on_workers(reads).select("*", F.coalesce("quality", F.lit("")).alias("_q"))
    names = reads.columns
    n = len(names)

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in byte_slices(batch.column(n)):
                size = np.diff(offsets)
                total = np.r_[0, np.cumsum(data.astype(np.int64) - 33)]
                begin = np.arange(max(0, len(data) - window + 1))
                owner = np.repeat(np.arange(len(size)), size)[: len(begin)]
                low = (total[begin + window] - total[begin] < mean * window) & (begin + window <= offsets[owner + 1])
                cut = size.copy()
                np.minimum.at(cut, owner[low], begin[low] - offsets[owner[low]])
                part = batch.slice(first, len(size))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(cut.astype(np.int32))], [*names, "_cut"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in reads.schema)
    return source.mapInArrow(cuts, f"{kinds}_cut int")


def trim(reads: DataFrame, *, head: int = 0, tail: int = 0, window: int | None = None, mean: int = 13, poly_g: int | None = None) -> DataFrame:
    """Cut bases at both ends, a poor end by a sliding window, and a run of Gs at the end."""
    columns, length = reads.columns, F.length("sequence")
    if window:
        reads = with_window_cuts(reads, window, mean)
        length = F.least(length, F.col("_cut"))
    if poly_g:
        length = F.least(length, F.length(F.regexp_replace("sequence", f"G{{{poly_g},}}$", "")))
    rows = reads.withColumn("_n", F.greatest(F.least(length, F.length("sequence") - tail) - head, F.lit(0)))
    cut = lambda c: F.substring(c, F.lit(head + 1), F.col("_n")).alias(c)
    return rows.select(*(cut(c) if c in ("sequence", "quality") else c for c in columns))


def agreeing(reads: DataFrame, mates: DataFrame) -> DataFrame:
    """Reads whose mate (by read_index) is still there."""
    return reads.join(mates.select("read_index"), "read_index", "left_semi")


def as_reads(seqs: DataFrame, quality: str = "I", k: int | None = None, id_col: str = "id", seq_col: str = "sequence") -> DataFrame:
    """Sequences as reads of one quality; with ``k`` every k-mer as ``id_i``."""
    if k is None:
        rows = seqs.select(F.col(id_col).alias("header"), F.col(seq_col).alias("sequence"))
    else:
        rows = seqs.select(F.col(id_col).alias("id"), F.posexplode(S.kmers(seq_col, k)).alias("i", "sequence"))
        rows = rows.select(F.concat_ws("_", "id", "i").alias("header"), "sequence")
    return rows.withColumn("quality", F.repeat(F.lit(quality), F.length("sequence")))


def matched_mates(reads: DataFrame) -> DataFrame:
    """Reads named x/1 and x/2 with their targets: whether the mates share none of them."""
    name, mate = F.regexp_replace("header", "/[12]$", ""), F.substring("header", -1, 1)
    rows = reads.select(name.alias("name"), mate.alias("mate"), "targets")
    one = rows.filter("mate = '1'").select("name", F.col("targets").alias("t1"))
    two = rows.filter("mate = '2'").select("name", F.col("targets").alias("t2"))
    return one.join(two, "name").withColumn("different", ~F.arrays_overlap("t1", "t2"))
