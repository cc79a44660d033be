"""Exact deduplication as a tree merge of sorted digest runs, with DataFrame operations only.

Every partition of the digests is a run, with its number; equal digests of a run are one entry (digest,
kept id, rows).  In binomial rounds the runs whose numbers differ in one digit only (i, i + w, i + 2w ...)
exchange their entries, digest range by digest range, and merge: the entries that meet are put in the
order of their digests, equal ones are neighbours, and a window over each such group makes one entry
of it.  After the last round one run is left, in as many ranges as there were before, so no round
ends in one task, and no digest ever brings more entries together than a round merges runs.  Each
level is written once; the verdicts travel the same levels back down, from the root's groups of
two rows and more to the rows themselves, so a group that holds a third of all rows is never
joined under one key.

Entries are verified at every level: two texts are the same only if SHA-256, a second
independent 64-bit hash and the byte length agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, written

KEY = ["digest", "check", "size"]


def digest_ranges(df: DataFrame) -> int:
    """How many ranges digests are dealt into: a power of two, 16 for each shuffle partition or more."""
    return 1 << (16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length()


BEST = {"largest": F.max, "smallest": F.min}


def merge_round(level: DataFrame, key: list[str], keep: str, bits: int) -> DataFrame:
    """One round: runs that share all but the last ``bits`` bits of their numbers become one.

    The window's order is the order of the merged run: entries of a digest are neighbours in it, one from each of the runs at most.
    """
    met = level.withColumn("run", F.shiftright("run", bits)).repartition("run", "range")
    order = Window.partitionBy("run", "range", *key).orderBy("keep_id")
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best, rows = BEST[keep]("keep_id").over(group), F.sum("group_size").over(group)
    entries = met.select("run", "range", *key, best.alias("keep_id"), rows.alias("group_size"), F.row_number().over(order).alias("nth"))
    return entries.filter("nth = 1").drop("nth")


def merge_runs(rows: DataFrame, key: list[str], head: Column, *, keep: str, ways: int = 32) -> DataFrame:
    """``rows`` (doc_id, the key and more) with keep_id and group_size of their group; null for groups of one row.

    ``head`` is a long, the leading 64 bits of the digest.  ``ways`` runs (a power of two) merge into
    one in every round.  The runs and what was found of them are written tables that the result reads; the
    levels between are deleted.
    """
    bits, ranges = ways.bit_length() - 1, digest_ranges(rows)
    place = F.shiftrightunsigned(head, 65 - ranges.bit_length()).cast("int")
    runs = written(rows.withColumns({"run": F.spark_partition_id(), "range": place}), "runs")
    first = runs.groupBy("run", "range", *key).agg(BEST[keep]("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    levels, left = [written(first, "level")], (runs.agg(F.max("run")).first()[0] or 0) + 1
    while left > 1:
        levels.append(written(merge_round(levels[-1], key, keep, bits), "level"))
        left = -(-left // ways)
    found = levels[-1].filter("group_size > 1")
    for level in reversed(levels[:-1]):
        down = level.select(F.shiftright("run", bits).alias("up"), F.col("run").alias("own"), "range", *key)
        found = down.join(found.withColumnRenamed("run", "up"), ["up", "range", *key]).drop("up").withColumnRenamed("own", "run")
    found = written(found, "found")
    discard(*levels)
    return runs.join(found, ["run", "range", *key], "left").drop("run", "range")


def exact_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    ways: int = 32,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``largest`` or ``smallest`` id.  Null texts count as empty texts, and all empty
    texts are one group.  Rows that repeat an id and a text are counted one by one and are all
    kept where that id is kept; a null id is kept only in a group without any other id (its
    keep_id is null).  Other columns of the input are ignored; an empty table gives no rows.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("t")).select(
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").alias("size"),
    )
    head = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    joined = merge_runs(rows, KEY, F.shiftleft(head, 8), keep=keep, ways=ways)
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  Ids must be unique for that."""
    kept = exact_groups(docs, id_col=id_col, text_col=text_col, **options).filter("kept")
    return docs.join(kept.select(F.col("doc_id").alias("_sl_id")), F.col(id_col).eqNullSafe(F.col("_sl_id")), "left_semi")
