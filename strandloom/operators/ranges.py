"""Joins on positions: bands, intervals and nearest neighbours, all as equi-joins on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases of a bin of the interval join.
BIN = 1 << 14
#: Bases between the start and the end of variants whose neighbours are found in one order.
SHORT = 64


def _mates_by_join(base: DataFrame, width: int, one: Column) -> DataFrame:
    """(seq, s, e, h, found): the mates of rows of ``base`` (seq, s, e, h) where one of a pair is ``one`` (a condition).

    A variant that begins near another one's end is near it, and the other is near the first: one join finds both.
    Both sides are binned by ``width``, so a partner lies in the same bin or a neighbouring one.
    """
    every = base.distinct().withColumn("_one", one)
    around = F.explode(F.array(*(F.floor(F.col("s") / width) + d for d in (-1, 0, 1)))).alias("bin")
    starts = every.select("seq", "s", "e", "h", "_one", around)
    ends = every.select("seq", *(F.col(c).alias(f"o{c}") for c in ("s", "e", "h")), F.col("_one").alias("_other"), F.floor(F.col("e") / width).alias("bin"))
    same = F.col("h").eqNullSafe(F.col("oh")) & (F.col("s") == F.col("os")) & (F.col("e") == F.col("oe"))
    met = starts.join(ends, ["seq", "bin"]).filter((F.col("_one") | F.col("_other")) & (F.abs(F.col("oe") - F.col("s")) <= width) & ~same)
    own, other = F.struct("s", "e", "h"), F.struct(F.col("os").alias("s"), F.col("oe").alias("e"), F.col("oh").alias("h"))
    side = lambda own, mate: F.struct(own.alias("own"), F.struct(mate["h"].alias("other"), mate["s"].alias("s"), mate["e"].alias("e")).alias("mate"))
    both = met.select("seq", F.inline(F.array(side(own, other), side(other, own))))
    return both.groupBy("seq", "own").agg(F.collect_set("mate").alias("found")).select("seq", "own.*", "found")


def nearby_variants(variants: DataFrame, k: int, seq_col: str = "seq_id", start: str = "start", end: str = "end", header: str = "header", longest: int | None = None) -> DataFrame:
    """Per variant: nearby_variants (headers of others on the sequence with |other end - start| or
    |other start - end| under k) and nearby_variants_count.

    Variants whose start and end are up to SHORT apart meet in one order of a bin of their sequence, with those at the
    edges of the bins around it; nothing is joined, and rows that are dealt by their sequence stay where they are.  Pairs
    of a longer one are joined.  ``longest``: no start and end of ``variants`` are further apart; looked up if not given.
    """
    width = max(1, k - 1)
    base = variants.select(F.col(seq_col).alias("seq"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(header).alias("h"))
    size = F.abs(F.col("e") - F.col("s"))
    longest = (base.agg(F.max(size).alias("n")).first()["n"] or 0) if longest is None else longest
    reach = width + min(longest, SHORT)
    bins, own_bin = max(BIN, 8 * reach), F.floor(F.col("s") / F.lit(max(BIN, 8 * reach)))
    around = F.sequence(F.floor((F.col("s") - reach) / bins), F.floor((F.col("s") + reach) / bins))
    near = Window.partitionBy("seq", "bin").orderBy("s").rangeBetween(-reach, reach)
    mate = F.struct(F.col("h").alias("other"), "s", "e")
    met = base.select("*", F.explode_outer(around).alias("bin")).withColumn("_met", F.collect_list(mate).over(near)).filter((F.col("bin") == own_bin) | F.col("bin").isNull())
    close = lambda m: (F.abs(m["e"] - F.col("s")) <= width) | (F.abs(m["s"] - F.col("e")) <= width)
    same = lambda m: m["other"].eqNullSafe(F.col("h")) & (m["s"] == F.col("s")) & (m["e"] == F.col("e"))
    found = F.filter("_met", lambda m: F.coalesce(close(m) & ~same(m) & F.col("seq").isNotNull(), F.lit(False)))
    if longest > SHORT:
        more = _mates_by_join(base, width, size > SHORT)
        found = F.concat(found, F.coalesce("found", F.array().cast(dict(more.dtypes)["found"])))
        met = met.join(more.withColumnsRenamed({c: f"_{c}" for c in ("seq", "s", "e", "h")}), (F.col("seq") == F.col("_seq")) & (F.col("s") == F.col("_s")) & F.col("e").eqNullSafe(F.col("_e")) & F.col("h").eqNullSafe(F.col("_h")), "left")
    lists = F.transform(F.array_sort(F.array_distinct(found)), lambda m: m["other"])
    return met.select(F.col("h").alias(header), lists.alias("nearby_variants")).withColumn("nearby_variants_count", F.size("nearby_variants"))


def first_interval(points: DataFrame, intervals: DataFrame, *, seq: str = "seq_id", pos: str = "pos", label: str = "gene_id", default: str = "unknown") -> DataFrame:
    """``points`` with ``label`` of the first interval (by ``ordinal``) that holds them, ends included.

    ``intervals``: seq, start, end, label, ordinal.
    """
    bins = intervals.select(
        F.col(seq).alias("_seq"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col(label).alias("_label"), "ordinal",
        F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("end") / BIN))).alias("_bin"),
    )
    keyed = points.select(seq, pos).distinct().withColumn("_bin", F.floor(F.col(pos) / BIN))
    hit = keyed.join(bins, (F.col(seq) == F.col("_seq")) & (keyed["_bin"] == bins["_bin"]) & F.col(pos).between(F.col("_s"), F.col("_e")))
    first = hit.groupBy(seq, pos).agg(F.min_by("_label", "ordinal").alias(label))
    return points.join(first, [seq, pos], "left").withColumn(label, F.coalesce(label, F.lit(default)))


def nearest_junction(variants: DataFrame, junctions: DataFrame, *, seq: str = "seq_id", start: str = "start", end: str = "end", near: int = 10) -> DataFrame:
    """``variants`` with distance_to_nearest_splice_junction (null without junctions on the
    sequence) and is_near_splice_junction_<near>.

    ``junctions``: seq, position.  Both are put in one order inside bins of positions, and the
    junction before and after each end of a variant is carried along it.  What a bin gets from the
    bins around it comes from a table of one row per bin.
    """
    places = variants.select(F.col(seq).alias("_seq"), F.explode(F.array(start, end)).alias("_at")).distinct()
    marks = junctions.select(F.col(seq).alias("_seq"), F.col("position").alias("_at"), F.col("position").alias("_mark")).distinct()
    both = places.withColumn("_mark", F.lit(None).cast(dict(marks.dtypes)["_mark"])).union(marks)
    both = both.withColumn("_bin", F.floor(F.col("_at") / BIN))
    bins = both.groupBy("_seq", "_bin").agg(F.min("_mark").alias("_lo"), F.max("_mark").alias("_hi"))
    up, down = (Window.partitionBy("_seq").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_bin"), F.desc("_bin")))
    bins = bins.select("_seq", "_bin", F.max("_hi").over(up).alias("_left"), F.min("_lo").over(down).alias("_right"))
    own = Window.partitionBy("_seq", "_bin")
    before = F.max("_mark").over(own.orderBy("_at"))
    after = F.min("_mark").over(own.orderBy(F.desc("_at")))
    both = both.select("*", before.alias("_before"), after.alias("_after")).join(bins, ["_seq", "_bin"])
    gap = F.least(F.col("_at") - F.coalesce("_before", "_left"), F.coalesce("_after", "_right") - F.col("_at"))
    gaps = both.withColumn("_gap", gap).filter("_mark IS NULL").select("_seq", "_at", "_gap")
    out = variants
    for i, c in enumerate((start, end)):
        own = gaps.select(F.col("_seq").alias(f"_q{i}"), F.col("_at").alias(f"_p{i}"), F.col("_gap").alias(f"_g{i}"))
        out = out.join(own, (F.col(seq) == F.col(f"_q{i}")) & (F.col(c) == F.col(f"_p{i}")), "left").drop(f"_q{i}", f"_p{i}")
    distance = F.least("_g0", "_g1")
    out = out.withColumn("distance_to_nearest_splice_junction", distance)
    return out.withColumn(f"is_near_splice_junction_{near}", distance <= near).drop("_g0", "_g1")


def genome_to_transcript(points: DataFrame, exons: DataFrame) -> DataFrame:
    """``points`` (transcript_id, pos) with transcript_pos: bases of the exons before it in strand
    order, plus its place in its own exon (from 1); null outside.  ``exons``: transcript_id, start, end, strand."""
    size = F.col("end") - F.col("start") + 1
    order = Window.partitionBy("transcript_id").orderBy(F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start")))
    placed = exons.withColumn("_before", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size)
    placed = placed.select("*", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("end") / BIN))).alias("_bin"))
    keyed = points.select("transcript_id", "pos").distinct().withColumn("_bin", F.floor(F.col("pos") / BIN))
    joined = keyed.join(placed, ["transcript_id", "_bin"]).filter(F.col("pos").between(F.col("start"), F.col("end")))
    within = F.when(F.col("strand") == "-", F.col("end") - F.col("pos")).otherwise(F.col("pos") - F.col("start")) + 1
    found = joined.groupBy("transcript_id", "pos").agg(F.min(F.col("_before") + within).alias("transcript_pos"))
    return points.join(found, ["transcript_id", "pos"], "left")


def transcript_lengths(gtf: DataFrame) -> DataFrame:
    """Per transcript: utr5, utr3, exons (summed lengths) and transcript_length, their sum."""
    size = F.col("end") - F.col("start") + 1
    part = lambda *f: F.coalesce(F.sum(F.when(F.col("feature").isin(*f), size)), F.lit(0))
    out = gtf.groupBy("transcript_id").agg(
        part("five_prime_utr", "5UTR").alias("utr5"), part("three_prime_utr", "3UTR").alias("utr3"), part("exon").alias("exons")
    )
    return out.withColumn("transcript_length", F.col("utr5") + F.col("utr3") + F.col("exons"))


def within_strand_reach(variants: DataFrame, lengths: DataFrame, *, end: str, read_length: int, forgiveness: int = 100, cds: bool = True) -> DataFrame:
    """Variants that reads from one end (5p or 3p) of a transcript can reach.

    ``variants``: header, transcript_id, start, end; without a known transcript they stay.
    """
    joined = variants.join(lengths.select("transcript_id", "utr5", "transcript_length"), "transcript_id", "left")
    shift = F.coalesce(F.col("utr5"), F.lit(0)) if cds else F.lit(0)
    if end == "5p":
        keep = F.col("start") + shift <= read_length + forgiveness
    else:
        keep = F.col("end") + shift >= F.col("transcript_length") - read_length - forgiveness
    return joined.filter(keep | F.col("transcript_length").isNull()).drop("utr5", "transcript_length")
