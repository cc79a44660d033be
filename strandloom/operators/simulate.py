"""Synthetic reads with known parents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from .build import windows
from .fixed import materialised
from .number import last_before, running_totals
from .sample import draw


def every_read(parents: DataFrame, read_length: int, strand: str = "f", mutant: bool = True) -> DataFrame:
    """All reads of every parent (vcrs_id, sequence): each start, on strand f, r or both.

    Ids are ``{vcrs_id}_{start}{strand}{M|W}``."""
    starts = S.positions(F.length("sequence") - read_length + 1)
    rows = parents.select("vcrs_id", "sequence", F.explode(starts).alias("at")).withColumn("start", F.col("at") - 1)
    strands = {"f": ["f"], "r": ["r"], "both": ["f", "r"]}[strand]
    rows = rows.withColumn("strand", F.explode(F.array(*map(F.lit, strands))))
    forward = F.substring("sequence", F.col("at"), F.lit(read_length))
    read = F.when(F.col("strand") == "r", S.reverse_complement(forward)).otherwise(forward)
    kind = F.lit("M" if mutant else "W")
    name = F.concat(F.col("vcrs_id"), F.lit("_"), F.col("start").cast("string"), F.col("strand"), kind)
    return rows.select(name.alias("read_id"), "vcrs_id", "start", "strand", read.alias("sequence"), kind.alias("kind"))


def sampled_reads(parents: DataFrame, read_length: int, reads: int, *, seed: int = 42, with_replacement: bool = True, strand: str = "random", mutant: bool = True) -> DataFrame:
    """``reads`` reads per parent at seeded random starts; the same for any partitioning."""
    draw = lambda *salt: F.pmod(F.xxhash64("vcrs_id", F.col("n"), F.lit(seed), *map(F.lit, salt)), F.lit(1 << 52)) / float(1 << 52)
    span = F.length("sequence") - read_length + 1
    if with_replacement:
        rows = parents.filter(span > 0).select("*", F.explode(F.sequence(F.lit(0), F.lit(reads - 1))).alias("n"))
        rows = rows.withColumn("start", F.floor(draw(1) * span).cast("int"))
    else:
        order = F.array_sort(F.transform(F.sequence(F.lit(0), span - 1), lambda i: F.struct(F.xxhash64("vcrs_id", i, F.lit(seed)).alias("r"), i.alias("i"))))
        rows = parents.filter(span > 0).select("*", F.posexplode(F.slice(order, 1, reads)).alias("n", "_o")).withColumn("start", F.col("_o.i")).drop("_o")
    side = F.when(draw(2) < 0.5, "f").otherwise("r") if strand == "random" else F.lit(strand)
    rows = rows.withColumn("strand", side)
    forward = F.substring("sequence", F.col("start") + 1, F.lit(read_length))
    read = F.when(F.col("strand") == "r", S.reverse_complement(forward)).otherwise(forward)
    kind = "M" if mutant else "W"
    name = F.concat(F.col("vcrs_id"), F.lit("_"), F.col("start").cast("string"), F.col("strand"), F.lit(kind), F.lit("_"), F.col("n").cast("string"))
    return rows.select(name.alias("read_id"), "vcrs_id", "start", "strand", read.alias("sequence"), F.lit(kind).alias("kind"))


def sequencing_errors(reads: DataFrame, *, rate: float = 1e-4, shares: tuple[float, float, float] = (0.85, 0.1, 0.05), max_errors: int | None = None, seed: int = 42) -> DataFrame:
    """Reads with random errors, seeded by their ids.

    A base errs with probability ``rate``.  It is replaced with probability ``shares[0]``; else a
    second draw replaces it by any base (below ``shares[2]``) or deletes it.  Deletions don't count
    towards ``max_errors``.
    """

    draw = lambda i, n: F.pmod(F.xxhash64("read_id", i, F.lit(seed + 101 * n)), F.lit(1 << 52)) / float(1 << 52)
    hit = lambda i: draw(i, 0) < rate
    other, any_base = (lambda i: draw(i, 1) < shares[0]), (lambda i: draw(i, 2) < shares[2])
    pick = lambda bases, i: F.substring(bases, F.floor(draw(i, 3) * F.length(bases)).cast("int") + 1, F.lit(1))
    places = S.positions(F.length("sequence"))
    last = F.length("sequence")
    if max_errors is not None:  # the place of the last error that is allowed
        counted = F.filter(places, lambda i: hit(i) & (other(i) | any_base(i)))
        last = F.when(F.size(counted) > max_errors, F.get(counted, max_errors - 1) if max_errors else F.lit(0)).otherwise(last)

    def read(i: Column) -> Column:
        base = F.substring("sequence", i, F.lit(1))
        wrong = F.when(other(i), pick(F.replace(F.lit("ACGT"), base, F.lit("")), i)).when(any_base(i), pick(F.lit("ACGT"), i)).otherwise("")
        return F.when(hit(i) & (i <= F.col("_last")), wrong).otherwise(base)

    return reads.withColumn("_last", last).withColumn("sequence", F.array_join(F.transform(places, read), "")).drop("_last")


def noisy_quality(reads: DataFrame, mean: float = 30, sd: float = 5, seed: int = 42) -> DataFrame:
    """Qualities from a normal distribution within 0 .. 40, drawn from hashes of the read and place."""
    unit = lambda i, s: (F.pmod(F.xxhash64("read_id", i, F.lit(seed + s)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    normal = lambda i: F.sqrt(-2 * F.log(unit(i, 0))) * F.cos(2 * math.pi * unit(i, 1))
    score = lambda i: F.greatest(F.lit(0), F.least(F.lit(40), F.round(mean + sd * normal(i)).cast("int")))
    return reads.withColumn("quality", F.array_join(F.transform(S.positions(F.length("sequence")), lambda i: F.chr(score(i) + 33)), ""))


def free_starts(sequences: DataFrame, ranges: DataFrame, read_length: int) -> DataFrame:
    """(seq_id, first, n): runs of starts from which a read touches no range (seq_id, start, end, both ends included).

    ``sequences``: seq_id, length.  They are the gaps between ranges, less what the end of a read needs.
    """
    ends = sequences.select("seq_id", F.col("length").cast("long").alias("start"), F.col("length").cast("long").alias("end"))
    marks = ranges.join(sequences.select("seq_id"), "seq_id", "left_semi").select("seq_id", F.col("start").cast("long"), F.col("end").cast("long")).unionByName(ends)
    before = Window.partitionBy("seq_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    first = F.greatest(F.coalesce(F.max("end").over(before) + 1, F.lit(0)), F.lit(0))
    gaps = marks.select("seq_id", first.alias("first"), "start")
    return gaps.select("seq_id", "first", (F.col("start") - read_length - F.col("first") + 1).alias("n")).filter("n > 0")


def background_reads(reference: DataFrame, ranges: DataFrame, n: int, read_length: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` reads of ``reference`` (seq_id, sequence) that touch no range (seq_id, start, end) of it.

    Every free place is equally likely, with replacement; there are none if no place is free.  Places are
    drawn first, as numbers among all free ones, and bases are fetched from the tiles they lie in.
    """
    sizes = reference.select("seq_id", F.length("sequence").alias("length"))
    gaps = materialised(running_totals(free_starts(sizes, ranges, read_length), "n", "seq_id", "first", name="place"))
    total = gaps.agg(F.sum("n")).first()[0] or 0
    draws = reference.sparkSession.range(n if total else 0).select(F.col("id").alias("i"), F.floor(draw(seed, "id") * total).cast("long").alias("place"))
    marks = gaps.select("place", "seq_id", (F.col("first") - F.col("place")).alias("_shift"))
    rows = last_before(draws, marks, "place").select("i", "seq_id", (F.col("place") + F.col("_shift")).alias("start"))
    rows = windows(rows.withColumn("_end", F.col("start") + read_length), reference.select("seq_id", "sequence"), "start", "_end", "_found", longest=read_length)
    return rows.select(F.concat_ws("_", "seq_id", "start", "i").alias("read_id"), "seq_id", "start", F.col("_found").alias("sequence"))


def tumor_purity(variants: DataFrame) -> DataFrame:
    """mutant reads / all reads of each variant; 0 where it has none."""
    m, w = F.col("number_of_reads_mutant"), F.col("number_of_reads_wt")
    return variants.withColumn("tumor_purity", F.coalesce(F.try_divide(m.cast("double"), m + w), F.lit(0.0)))
