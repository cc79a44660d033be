"""Importance resampling towards a target distribution, over hashed word n-grams.

The CRC of every word is worked out once; CRCs of word n-grams are composed from those with
matrices over GF(2) (``crc``), so the text of an n-gram never exists.  Two passes read the texts:
the first counts buckets of the corpus and of the target, the second adds up the logarithmic gains
of each document's buckets.  What is drawn are the documents with the highest sums of weight and
Gumbel noise: a sample without replacement, in proportion to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import on_workers, written
from .crc import crcs, shifted
from .ragged import SLICE_BYTES, byte_slices

#: Bytes that words are made of, after lower-casing A-Z: digits, letters, and all of non-ASCII characters.
WORD = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased texts that follow each other; none spans two texts."""
    inside = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    end = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    return start, end


def pieces(texts: pa.Array, context: int, size: int = SLICE_BYTES) -> Iterator[tuple]:
    """(first row, lower-cased bytes, offsets, word starts, word ends, words that were seen before).

    A very long text comes in several pieces, cut between words; each begins with the last
    ``context`` words of the one before.
    """
    for first, raw, offsets in byte_slices(texts, size):
        if len(raw) <= 2 * size:
            data = LOWER[raw]
            yield first, data, offsets, *word_spans(data, offsets), 0
            continue
        at, to, seen = 0, 0, 0
        while to < len(raw):
            to = min(to + size, len(raw))
            while to < len(raw) and WORD[LOWER[raw[to]]]:
                to += 1
            data = LOWER[raw[at:to]]
            ends = np.array([0, len(data)])
            start, end = word_spans(data, ends)
            yield first, data, ends, start, end, seen
            seen = min(context, len(start))
            at = at + int(start[-seen]) if seen else to


def ngram_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 .. words: the last word and the CRC of every n-gram that lies in one text."""
    size, one = end - start, crcs(data, start, end)
    space = np.full(1, 0xE96CCF45, np.uint32)  # the CRC of one space
    spaced = shifted(np.broadcast_to(space, one.shape), size) ^ one
    last = np.arange(len(start))
    code = one
    for n in range(1, words + 1):
        if n > 1:
            code = shifted(code[:-1], size[n - 1 :] + 1) ^ spaced[n - 1 :]
            last = last[1:]
        same = owner[last] == owner[last - (n - 1)]
        yield last[same], code[same]


def _features(texts: pa.Array, words: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, owner of each new word, owner and bucket of each feature)."""
    for first, data, offsets, start, end, seen in pieces(texts, words - 1):
        owner = np.searchsorted(offsets, start, side="right") - 1
        owners, found = [], []
        for last, code in ngram_crcs(data, start, end, owner, words):
            fresh = last >= seen
            owners.append(owner[last[fresh]])
            found.append((code[fresh] % np.uint32(buckets)).astype(np.int64))
        yield first, len(offsets) - 1, owner[seen:], np.concatenate(owners), np.concatenate(found)


def bucket_counts(texts: DataFrame, *, text_col: str = "text", words: int = 3, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket.  A task sends its sums once."""
    source = on_workers(texts).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, _, found in _features(batch.column(0), words, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return source.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, smoothed by one.  Both inputs have ``buckets`` rows at most."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((corpus, s), (target, t)):
        for r in counts.collect():
            into[r["bucket"]] = r["n"]
    big_s, big_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    ratio = (t + 1) * big_s / ((s + 1) * big_t)
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, n_words, n_features, weight (the sum of the gains of all features) of every row."""
    source = on_workers(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type, buckets = source.schema["doc_id"].dataType.simpleString(), len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, rows, of_word, owner, found in _features(batch.column(1), words, buckets):
                own = slice(first, first + rows)
                n_words[own] += np.bincount(of_word, minlength=rows)
                n_features[own] += np.bincount(owner, minlength=rows)
                weight[own] += np.bincount(owner, weights=gains[found], minlength=rows).astype(np.int64)  # whole numbers below 2**53
            columns = [pa.array(x) for x in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    return source.mapInArrow(weigh, f"doc_id {id_type}, n_words long, n_features long, weight long")


def _ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank``, gapless from 1 in this order: ranges are sorted, and begin after the rows before them."""
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sorted_ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_sl_range"), inside.alias("_sl_at"))
    sorted_ranges = written(sorted_ranges, "ranges")
    sizes = sorted(map(tuple, sorted_ranges.groupBy("_sl_range").count().collect()))  # one number for each range
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    starts = rows.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(sizes, before, strict=False)], "_sl_range int, _sl_before long")
    out = sorted_ranges.join(F.broadcast(starts), "_sl_range")
    return out.withColumn("rank", F.col("_sl_before") + F.col("_sl_at") + 1).select(*rows.columns, "rank")


def importance_ranks(
    docs: DataFrame,
    target: DataFrame,
    *,
    share: tuple[int, int] = (5, 100),
    min_words: int = 20,
    words: int = 3,
    buckets: int = 10_000,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_features, weight, score, rank (null where it isn't drawn).

    Features are all runs of 1 to ``words`` words; a feature's bucket is its CRC-32 modulo
    ``buckets``.  Of the N rows with ``min_words`` words or more, the N * share[0] // share[1] with the
    highest scores are drawn, ties to the smaller id.  Null and empty texts have no features and weigh 0.
    Ids may be null (their noise is that of an empty id; they come last in ties) or repeat; each row
    stands for itself.  Other columns are ignored; an empty table gives no rows, an empty
    target counts as one without words.  What reaches the driver are ``buckets`` numbers twice and one
    number for each shuffle partition.
    """
    counted = (bucket_counts(docs, text_col=text_col, words=words, buckets=buckets), bucket_counts(target, text_col=target_text_col, words=words, buckets=buckets))
    gains = bucket_gains(*counted, buckets)
    scored = weights(docs, gains, id_col=id_col, text_col=text_col, words=words)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = written(scored.withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_words") >= min_words
    ranked = _ranked(scored.filter(able), F.desc("score"), F.asc_nulls_last("doc_id"))
    drawn = scored.filter(able).count() * share[0] // share[1]
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns.  Ids must be unique for that."""
    ranks = importance_ranks(docs, target, id_col=id_col, **options).filter("rank IS NOT NULL")
    return docs.join(ranks.select(F.col("doc_id").alias("_sl_id")), F.col(id_col) == F.col("_sl_id"), "left_semi")
