"""Line deduplication by winnowing over line hashes, with DataFrame operations only.

Every non-blank line is hashed.  The gram of a line is the shortest run of lines that begins there
and has at least ``gram_words`` words; of all grams that begin within ``window_words`` words of a
line, the one with the smallest hash is the line's fingerprint.  So any run of ``gram_words +
window_words`` words (less one) that two texts share holds a fingerprint that both have, and it is
the fingerprint of the run's first line.

Where a fingerprint occurs more than once, the runs are looked up themselves: the shortest runs of
``min_words`` words or more that begin with a line or end with it.  Every occurrence but the first
goes.  These runs cover all lines of any longer repeated run: its first one begins with it, and a
line behind that one ends such a run of its own.  So a repeated run goes as a whole, however long
it and its lines are and whichever of the earlier texts has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Rows with deletions and deleted lines that may be broadcast to the texts; beyond that they are joined.
BROADCAST_LINES = 1_000_000


def row_key(id_col: str, text: Column) -> Column:
    """A row is known by its id and its text, so rows that repeat an id do no harm; two 64-bit hashes, so that no two
    of even 10**12 rows share a key."""
    return F.struct(F.xxhash64(F.col(id_col), text, F.octet_length(text)).alias("a"), F.xxhash64(F.lit(7), text, F.col(id_col)).alias("b"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, row, pos, hash, words, before (words of the row's lines before) of every non-blank line."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc"), text.alias("t"))
    source = source.select("doc", row_key("doc", F.col("t")).alias("row"), F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    source = source.withColumn("line", F.trim(F.translate("line", "\r\t", "  "))).filter("line <> ''")
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lines = source.select("doc", "row", "pos", F.xxhash64("line").alias("hash"), words.cast("int").alias("words"))
    lines = lines.repartition("row").dropDuplicates(["row", "pos"])
    ordered = Window.partitionBy("row").orderBy("pos")
    return lines.withColumn("before", F.sum("words").over(ordered.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"])


def _gram(reach: int, name: str, *, back: bool = False) -> dict[str, Column]:
    """Columns ``name`` and ``name``_end: hash and last position of the shortest run from here with
    at least ``reach`` words (null where the text ends before).

    With ``back``, of the shortest run that ends here; ``name``_end is its first position.
    """
    # lines that begin within reach-1 words of this one (or end so): together they have at least reach words
    if back:
        span = Window.partitionBy("row").orderBy("after").rangeBetween(1 - reach, 0)
    else:
        span = Window.partitionBy("row").orderBy("before").rangeBetween(0, reach - 1)
    run = F.collect_list("hash").over(span)
    enough = F.sum("words").over(span) >= reach
    end = F.min("pos") if back else F.max("pos")
    return {
        name: F.when(enough, F.xxhash64(run, F.lit(reach))),
        f"{name}_end": F.when(enough, end.over(span)),
    }


def removed_lines(
    docs: DataFrame, *, min_words: int = 50, gram_words: int = 25, window_words: int = 25,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """row and removed (positions, in order) of every text with a later occurrence of a repeated run.

    Texts come in the order of their ids (null first), lines in their order; the first occurrence
    of a run stays.  Runs of fewer than ``min_words`` words stay everywhere.  Within one text a
    later repetition of a run is deleted as well, and so are blank lines inside deleted runs.
    """
    # every run of min_words words must hold a fingerprint
    gram_words = min(gram_words, (min_words + 1) // 2)
    window_words = min(window_words, min_words + 1 - gram_words)
    lines = _lines(docs, id_col, text_col).withColumns(_gram(gram_words, "gram"))
    near = Window.partitionBy("row").orderBy("before").rangeBetween(0, window_words - 1)
    # of equal hashes the last one in the window, in both texts alike
    best = F.min(F.struct(F.col("gram").isNull().alias("none"), "gram", (-F.col("pos")).alias("at"))).over(near)
    whole = F.sum("words").over(near) >= window_words
    lines = lines.withColumns({"best": best, "whole": whole})
    lines = lines.withColumn("mark", F.when(~F.col("best.none") & F.col("whole"), F.col("best.gram")))
    # neighbours share a fingerprint, and its place only moves on: one of them stands for it
    last = F.lag(F.when(F.col("mark").isNotNull(), F.col("best.at"))).over(Window.partitionBy("row").orderBy("before"))
    lines = lines.withColumn("fresh", F.col("mark").isNotNull() & ~last.eqNullSafe(F.col("best.at")))
    lines = written(lines.select("doc", "row", "pos", "hash", "words", "before", "mark", "fresh"), "lines")

    # texts shorter than a window have no fingerprint, and no run long enough
    prints = lines.filter("fresh").select("mark", "row")
    marks = prints.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark")
    hits = written(prints.join(marks, "mark"), "hits")
    spots = written(_spots(lines, hits, min_words), "spots")
    discard(lines, hits)

    place = F.struct("doc", "row", "start")
    head = spots.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    # written first, so that both sides of the join are exchanged and a hot run can be split
    head = written(head.select("run", "first"), "heads")
    later = spots.join(head, "run").filter(place != F.col("first")).select("row", "start", "end")
    later = later.repartition("row").groupBy("row", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    later = later.withColumn("from", F.greatest("start", F.max("end").over(before) + 1)).filter(F.col("from") <= F.col("end"))
    removed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("from", "end"))), lambda x: F.sequence(x["from"], x["end"])))
    out = written(later.groupBy("row").agg(removed.alias("removed")), "removed")
    discard(spots, head)
    return out


def _spots(lines: DataFrame, hits: DataFrame, min_words: int) -> DataFrame:
    """doc, row, run, start, end of the runs to look up: those that begin with a line of a repeated
    fingerprint.  Each is the shortest run of ``min_words`` words from its first line, or to its last.

    ``hits`` are (mark, row) of the repeated fingerprints; texts without any are left out before
    their runs are hashed.
    """
    nothing = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in ("doc", "pos", "hash", "words", "before")]
    marked = hits.distinct().select(*nothing[:1], "row", *nothing[1:], "mark", F.lit(True).alias("hit"))
    both = lines.select("doc", "row", "pos", "hash", "words", "before", "mark", F.lit(False).alias("hit")).union(marked)
    both = both.repartition("row").withColumns(
        {"any": F.max("hit").over(Window.partitionBy("row")), "again": F.max("hit").over(Window.partitionBy("row", "mark"))}
    )
    known = both.filter("any AND NOT hit").withColumn("after", F.col("before") + F.col("words"))
    known = known.withColumns(_gram(min_words, "long") | _gram(min_words, "past", back=True))
    back = Window.partitionBy("row").orderBy("after").rangeBetween(1 - min_words, 0)
    known = known.withColumns({"again": F.col("mark").isNotNull() & F.col("again")}).withColumn("past_again", F.first("again").over(back))
    ahead = F.struct(F.col("again"), F.col("long").alias("run"), F.col("pos").alias("start"), F.col("long_end").alias("end"))
    behind = F.struct(F.col("past_again").alias("again"), F.col("past").alias("run"), F.col("past_end").alias("start"), F.col("pos").alias("end"))
    found = F.filter(F.array(ahead, behind), lambda x: x["again"] & x["run"].isNotNull())
    return known.select("doc", "row", F.inline(found)).drop("again")


def deduplicate_lines(
    docs: DataFrame, *, min_words: int = 50, gram_words: int = 25, window_words: int = 25,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with their columns; ``text_col`` is without the later occurrences of repeated runs.

    Adds _sl_lines (lines of the text before) and _sl_removed (positions of the deleted lines, in
    order, or null).  Null and empty texts stay as they are, and so do texts without repetition.
    Rows that are equal in id and text are one text and stay equal.  Words are counted as spaces
    between them; lines are compared without the white space around them.
    """
    gone = removed_lines(docs, min_words=min_words, gram_words=gram_words, window_words=window_words, id_col=id_col, text_col=text_col)
    gone = gone.select(F.col("row").alias("_sl_row"), F.col("removed").alias("_sl_removed"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn("_sl_row", row_key(id_col, text))
    few = (gone.agg(F.count("*") + F.sum(F.size("_sl_removed"))).first()[0] or 0) <= BROADCAST_LINES
    joined = keyed.join(F.broadcast(gone) if few else gone, "_sl_row", "left")

    def cleaned(parts: Column) -> Column:
        filled = F.filter("_sl_removed", lambda i: F.trim(F.translate(F.get(parts, i), "\r\t", "  ")) != "")
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_sl_removed")
        left = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
        whole = F.col("_sl_removed").isNull()
        return F.struct(
            F.when(whole, F.col(text_col)).otherwise(left).alias("text"), filled.alias("removed"),
            F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).alias("lines"),
        )

    # over an array of one, so that lines are split once; what follows refers to the values, not to their making
    made = F.transform(F.array(F.split(text, "\n")), cleaned)
    rest = [c for c in docs.columns if c != text_col]
    out = joined.select(*rest, F.inline(made).alias("_sl_text", "_sl_filled", "_sl_lines"))
    names = [F.col("_sl_text").alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*names, F.col("_sl_filled").alias("_sl_removed"), "_sl_lines")
