"""FASTQ files of any number and size: four lines make a record, wherever files are split.

Spark splits large files, and a split knows neither how many lines lie before it nor where a record
begins.  A first pass counts the lines of every split and keeps its first three; sums over the
splits of a file then say how many lines of a split end a record of the split before, what number its
first own record has, and which lines complete its last one.  The second pass puts records
together inside the splits, so no read is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.fixed import materialised, on_workers

SPLIT = ["_path", "_block"]
#: Splits up to this number are broadcast (some hundred bytes each, counted first); more are joined by a shuffle.
BROADCAST_SPLITS = 100_000
#: Lines kept of a split may be long; the splits are broadcast only if all of them have no more characters than this.
BROADCAST_CHARS = 1 << 26


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(path, block, first row, last row + 1) of the runs of rows of one split; path and block are the first columns."""
    path, block = batch.column(0), batch.column(1).to_numpy()
    if not len(block):
        return
    new = np.r_[True, (block[1:] != block[:-1]) | pc.not_equal(path.slice(1), path.slice(0, len(block) - 1)).to_numpy(zero_copy_only=False)]
    starts = np.flatnonzero(new).tolist()
    for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
        yield path[a].as_py(), int(block[a]), a, b


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of lines and the first three lines of every split."""

    def row(path, block, lines, head):
        columns = [pa.array([path]), pa.array([block], pa.int64()), pa.array([lines], pa.int64()), pa.array([head], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, [*SPLIT, "_lines", "_head"])

    now, lines, head = None, 0, []
    for batch in batches:
        for path, block, a, b in _runs(batch):
            if (path, block) != now:
                if now:
                    yield row(*now, lines, head)
                now, lines, head = (path, block), 0, []
            head += batch.column(2).slice(a, min(b - a, 3 - len(head))).to_pylist()
            lines += b - a
    if now:
        yield row(*now, lines, head)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of every split; the last one of a split may lack lines (``_have`` says how many it has)."""

    def out(first: int, lines: pa.Array) -> pa.RecordBatch:
        n = -(-len(lines) // 4)
        held = pa.concat_arrays([lines, pa.nulls(4 * n - len(lines), lines.type)])
        every = lambda k: held.take(pa.array(np.arange(k, 4 * n, 4)))
        have = np.full(n, 4, np.int32)
        if len(lines) % 4:
            have[-1] = len(lines) % 4
        return pa.RecordBatch.from_arrays([pa.array(first + np.arange(n)), every(0), every(1), every(3), pa.array(have)], ["read_index", "header", "sequence", "quality", "_have"])

    now, skip, first, rest = None, 0, 0, None
    for batch in batches:
        for path, block, a, b in _runs(batch):
            if (path, block) != now:
                if now and len(rest):
                    yield out(first, rest)
                now, rest = (path, block), batch.column(2).slice(0, 0)
                skip, first = batch.column(3)[a].as_py(), batch.column(4)[a].as_py()
            lines = batch.column(2).slice(a, b - a)
            passed = min(skip, len(lines))
            skip -= passed
            lines = pa.concat_arrays([rest, lines.slice(passed)])
            whole = len(lines) // 4 * 4
            if whole:
                yield out(first, lines.slice(0, whole))
                first += whole // 4
            rest = lines.slice(whole)
    if now and len(rest):
        yield out(first, rest)


def splits(lines: DataFrame) -> DataFrame:
    """Per split: _skip (its lines that end the record before), _first (number of its first own record) and
    _after (up to three lines that come behind it, in which its last record may end)."""
    heads = materialised(lines.mapInArrow(_heads, "_path string, _block long, _lines long, _head array<string>"))
    in_file = Window.partitionBy("_path").orderBy("_block")
    before = F.coalesce(F.sum("_lines").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.flatten(F.array_compact(F.array(*(F.lead("_head", i).over(in_file) for i in (1, 2, 3)))))
    placed = heads.withColumns({"_before": before, "_after": F.slice(behind, 1, 3)})
    files = heads.groupBy("_path").agg(F.ceil(F.sum("_lines") / 4).alias("_records"))
    earlier = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = files.select("_path", F.coalesce(F.sum("_records").over(earlier), F.lit(0)).alias("_offset"))
    placed = placed.join(files, "_path")
    own = F.ceil(F.col("_before") / 4)
    skip = F.least(F.pmod(-F.col("_before"), F.lit(4)), F.col("_lines"))
    return materialised(placed.select(*SPLIT, skip.cast("int").alias("_skip"), (F.col("_offset") + own).alias("_first"), "_lines", "_after"))


def read_fastq(spark: SparkSession, path, file_index: int = 0) -> DataFrame:
    """file_index, read_index, header, sequence, quality of a file, a folder, or a list of files.

    ``read_index`` counts from 0 through the files in the order of their paths.  A record that ends with
    the file before it is complete has nulls; blank lines at the end of a file are no record, but count as
    one.  Files are read twice, and the splits must be the same both times: a session whose number of
    cores changes in between gets an error.
    """
    place = {"_path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}
    lines = on_workers(spark.read.text(path)).select(*(c.alias(n) for n, c in place.items()), "value")
    known = splits(lines)
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.array_join("_after", ""))), F.lit(0)).alias("chars")).first()
    few = size["n"] <= BROADCAST_SPLITS and size["chars"] <= BROADCAST_CHARS
    light = F.broadcast if few else lambda t: t
    starts = known.select(*SPLIT, "_skip", "_first")
    if not few:
        lines = lines.withColumn("_at", F.monotonically_increasing_id())
    joined = lines.join(light(starts), SPLIT, "left")
    if not few:
        joined = joined.sortWithinPartitions(*SPLIT, "_at")
    found = F.when(F.col("_first").isNull(), F.raise_error(F.lit("the splits of the files have changed since they were counted"))).otherwise(F.col("_first"))
    rows = joined.select(*SPLIT, "value", "_skip", found.alias("_first"))
    rows = rows.mapInArrow(_records, "read_index long, header string, sequence string, quality string, _have int")
    # records that begin in a split and end behind it
    own = F.col("_lines") - F.col("_skip")
    ends = known.filter(own % 4 > 0).select((F.col("_first") + F.floor(own / 4)).alias("read_index"), "_after")
    rows = rows.join(light(ends), "read_index", "left")
    later = lambda k: F.get("_after", F.lit(k) - F.col("_have"))
    filled = {c: F.when(F.col("_have") <= k, later(k)).otherwise(F.col(c)) for c, k in (("sequence", 1), ("quality", 3))}
    out = rows.withColumns(filled).withColumn("header", F.regexp_replace("header", "^@", ""))
    out = out.filter((F.col("header") != "") | (F.coalesce("sequence", F.lit("")) != ""))
    return out.select(F.lit(file_index).alias("file_index"), "read_index", "header", "sequence", "quality")
