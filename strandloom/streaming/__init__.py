"""Reads as a stream: assignment is stateless, molecules are counted once within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S


def assign_stream(reads: DataFrame, index: DataFrame, k: int, *, stranded: bool = False) -> DataFrame:
    """Stream of (read_index, ts, barcode, umi, target) by a static k-mer index: a read's k-mer hits,
    one row per read and target.  The index is static, so the join holds no state."""
    kmer = F.explode(F.array_distinct(S.kmers("sequence", k)))
    windows = reads.select("read_index", "ts", "barcode", "umi", kmer.alias("kmer"))
    if not stranded:
        windows = windows.withColumn("kmer", S.canonical("kmer"))
    return windows.join(index, "kmer").select("read_index", "ts", "barcode", "umi", "target")


def count_molecules(assigned: DataFrame, *, late: str = "10 minutes", window: str = "10 minutes") -> DataFrame:
    """Molecules per window, barcode and target; repeats of one (barcode, umi, target) count once."""
    once = assigned.withWatermark("ts", late).dropDuplicatesWithinWatermark(["barcode", "umi", "target"])
    return once.groupBy(F.window("ts", window), "barcode", "target").agg(F.count("*").alias("molecules"))
