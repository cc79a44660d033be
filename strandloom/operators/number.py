"""Numbers, sums and neighbours along a global order, without a single-task window, for any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fixed import materialised


def _dealt(rows: DataFrame, order: tuple, ranges: int | None = None) -> DataFrame:
    """``rows`` in sorted ranges, written down, with _range and _at (place in the range, from 0).

    Rows are dealt by a sample of *all* order columns, so a first column of few values still gives many
    ranges, and only rows that are equal in all of them stay together.
    """
    dealt = rows.repartitionByRange(*order) if ranges is None else rows.repartitionByRange(ranges, *order)
    place = {"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    return materialised(dealt.sortWithinPartitions(*order).withColumns(place))


def _before():
    """The ranges before one; there are as many rows as ranges, so one task sees few."""
    return Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def ranked(rows: DataFrame, *order: Column | str, name: str = "row_number", ranges: int | None = None) -> DataFrame:
    """``rows`` numbered from 1 in the order of columns of any type (``F.desc`` and the like work too).

    Ranges of rows are sorted, and a range's numbers begin after the rows of the ranges before it, which are
    counted once.
    """
    dealt = _dealt(rows, order, ranges)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_before"))
    out = dealt.join(F.broadcast(offsets), "_range")  # as many rows as shuffle partitions
    return out.withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def running_totals(rows: DataFrame, value: str, *order: Column | str, name: str = "total", ranges: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before, in this order."""
    dealt = _dealt(rows, order, ranges)
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_n"))
    offsets = sums.select("_range", F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(offsets), "_range")
    return out.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_at", "_before", "_own")


def last_before(points: DataFrame, marks: DataFrame, on: str, ranges: int | None = None) -> DataFrame:
    """``points`` with the columns of the last of ``marks`` whose ``on`` isn't above theirs (null where none is).

    An as-of join by one sort of both: inside a range the last mark is carried on row by row, and into a
    range comes the last mark of the ranges before it.  No point meets more than one mark.
    """
    wanted = [c for c in marks.columns if c != on]
    held = F.struct(on, *wanted)
    both = marks.select(on, F.lit(0).alias("_kind"), held.alias("_mark"))
    both = both.unionByName(points.select("*", F.lit(1).alias("_kind")), allowMissingColumns=True)
    dealt = _dealt(both, (on, "_kind"), ranges)
    lasts = dealt.groupBy("_range").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("_at"))).alias("_m"))
    carried = lasts.select("_range", F.last("_m", ignorenulls=True).over(_before()).alias("_carried"))
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("_own", F.last("_mark", ignorenulls=True).over(inside)).filter("_kind = 1").join(F.broadcast(carried), "_range")
    mark = F.coalesce("_own", "_carried")
    return out.select(*points.columns, *(mark[c].alias(c) for c in wanted))


def row_numbers(rows: DataFrame, *order: str, name: str = "row_number") -> DataFrame:
    """``rows`` numbered from 1 in the order of columns ``order``; nulls come first."""
    return ranked(rows, *order, name=name)


def numbered(rows: DataFrame, *order: str, prefix: str = "vcrs_", name: str = "vcrs_id") -> DataFrame:
    """Ids like vcrs_07: numbers in order, with as many digits as the last one has."""
    out = ranked(rows, *order, name="_number")
    total = out.agg(F.length(F.max("_number").cast("string")).alias("_digits"))
    out = out.crossJoin(F.broadcast(total))  # one row
    return out.withColumn(name, F.concat(F.lit(prefix), F.lpad(F.col("_number").cast("string"), F.col("_digits"), "0"))).drop("_number", "_digits")
