"""Profiles of reads: qualities and bases by cycle, and sequences that come too often."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ragged import byte_slices
from .fixed import on_workers

#: Qualities that are told apart (0 .. 93), and the offset of their characters (fixed values of the format).
QUALITIES, OFFSET = 94, 33
#: Counters of a task, in multiples of 1 / share.
SLACK = 4


def cycle_counts(reads: DataFrame, *groups: str) -> DataFrame:
    """(groups, cycle, kind, value, n): how many reads have a base or a quality at each cycle (from 1).

    ``kind`` is base (``value``: 0 to 4 for A, C, G, T and all else) or quality (``value``: the Phred score).  Every task adds up tables of fixed size
    for each group and cycle and sends them once; the sums add up in any order.
    """
    seq, quality = (F.coalesce(c, F.lit("")) for c in ("sequence", "quality"))
    group = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    source = on_workers(reads).select(F.to_json(group).alias("g"), seq.alias("s"), quality.alias("q"))
    base_of = np.full(256, 4, np.int64)
    for i, b in enumerate(b"ACGT"):
        base_of[b] = i

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            for value in pc.unique(batch.column(0)).to_pylist():
                own = batch.filter(pc.equal(batch.column(0), value))
                for kind, column, wide in (("base", 1, 5), ("quality", 2, QUALITIES)):
                    for _, data, offsets in byte_slices(own.column(column)):
                        if not len(data):
                            continue
                        cycle = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
                        what = base_of[data] if kind == "base" else np.clip(data.astype(np.int64) - OFFSET, 0, QUALITIES - 1)
                        sums = np.bincount(cycle * wide + what)
                        held = tables.get((value, kind), np.zeros(0, np.int64))
                        size = max(len(held), len(sums))
                        tables[value, kind] = np.pad(held, (0, size - len(held))) + np.pad(sums, (0, size - len(sums)))
        for (value, kind), held in tables.items():
            at = np.flatnonzero(held)
            wide = 5 if kind == "base" else QUALITIES
            columns = [pa.array([value] * len(at)), pa.array((at // wide + 1).astype(np.int32)), pa.array([kind] * len(at)), pa.array((at % wide).astype(np.int32)), pa.array(held[at])]
            yield pa.RecordBatch.from_arrays(columns, ["g", "cycle", "kind", "value", "n"])

    counts = source.mapInArrow(count, "g string, cycle int, kind string, value int, n long").groupBy("g", "cycle", "kind", "value").agg(F.sum("n").alias("n"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.select(*groups).schema) or "`all` int"
    named = counts.select(F.from_json("g", kinds).alias("g"), "cycle", "kind", "value", "n")
    return named.select(*(F.col(f"g.`{c}`") for c in groups), "cycle", "kind", "value", "n")


def quality_profile(reads: DataFrame, *groups: str) -> DataFrame:
    """One row per group and cycle: reads, mean_quality, median_quality, share_q20, share_q30, share_n, share_gc."""
    counts = cycle_counts(reads, *groups)
    keys = [*groups, "cycle"]
    base, quality = F.col("kind") == "base", F.col("kind") == "quality"
    of = lambda *v: F.sum(F.when(base & F.col("value").isin(*v), F.col("n")).otherwise(0))
    scored = F.sum(F.when(quality, F.col("n")).otherwise(0))
    above = lambda q: F.try_divide(F.sum(F.when(quality & (F.col("value") >= q), F.col("n")).otherwise(0)), scored)
    # the smallest quality that half of the reads don't exceed, from at most 94 numbers
    ladder = F.array_sort(F.collect_list(F.when(quality, F.struct("value", "n"))))
    total = F.aggregate(ladder, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["value"].isNull() & (2 * (a["seen"] + x["n"]) >= total), x["value"]).otherwise(a["value"]).alias("value"))
    median = F.aggregate(ladder, F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("value")), step)["value"]
    everything = F.sum(F.when(base, F.col("n")).otherwise(0))
    return counts.groupBy(*keys).agg(
        everything.alias("reads"), F.try_divide(F.sum(F.when(quality, F.col("n") * F.col("value"))), scored).alias("mean_quality"), median.alias("median_quality"),
        above(20).alias("share_q20"), above(30).alias("share_q30"), F.try_divide(of(4), everything).alias("share_n"), F.try_divide(of(1, 2), everything).alias("share_gc"),
    )


def _frequent(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Texts and counts; at most ``most`` are kept, and when there are more, all counts go down by as much as the (``most`` + 1)-th has.

    So a count is too low by the task's rows / ``most`` at most, and texts that are gone were that rare.
    """
    held = pa.table({"text": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    for batch in batches:
        counts = batch.column(0).value_counts()
        more = pa.table({"text": counts.field("values"), "n": counts.field("counts")})
        held = pa.concat_tables([held, more]).group_by("text").aggregate([("n", "sum")]).rename_columns(["text", "n"])
        if held.num_rows > most:
            n = held["n"].to_numpy()
            less = n - np.partition(n, len(n) - most - 1)[len(n) - most - 1]
            held = held.set_column(1, "n", pa.array(less)).filter(pa.array(less > 0))
    yield from held.to_batches()


def overrepresented(reads: DataFrame, share: float = 0.001, *, bases: int = 50, text_col: str = "sequence") -> DataFrame:
    """(sequence, n): what the first ``bases`` bases of more than ``share`` of all reads are, with exact counts.

    The first pass keeps a bounded number of counters in every task.  Their sums are too low by share / SLACK of all reads at most,
    so those that may be frequent enough are fewer than 1 / (share (1 - 1 / SLACK)): that few go to every task, and a second pass
    counts them exactly.  Null texts aren't looked at.
    """
    texts = on_workers(reads.select(F.left(F.col(text_col), F.lit(bases)).alias("text"))).filter("text IS NOT NULL")
    most = math.ceil(SLACK / share)
    total = texts.agg(F.count("*").alias("_total"))  # one row
    sums = texts.mapInArrow(lambda b: _frequent(b, most), "text string, n long").groupBy("text").agg(F.sum("n").alias("n"))
    near = sums.crossJoin(F.broadcast(total)).filter(F.col("n") > share * (1 - 1 / SLACK) * F.col("_total")).select("text")
    counted = texts.join(F.broadcast(near), "text", "left_semi").groupBy("text").agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(total)).filter(F.col("n") > share * F.col("_total")).select(F.col("text").alias("sequence"), "n")
