"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language come from one aggregation; the matrix of log probabilities
(buckets x languages, of fixed size) goes to all tasks, which score batches of texts in numpy:
every text is a sparse row of n-gram counts, and its scores are sums of the matrix's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER
from .chars import slices, tables
from .common import on_workers, smaller

UNKNOWN = "und"


class NgramCounter:
    """Hashes the letters' n-grams of sizes 1 to ``largest`` into ``1 << bits`` buckets."""

    def __init__(self, largest: int = 3, bits: int = 15):
        self.largest, self.bits = largest, bits

    def buckets(self, part) -> tuple[np.ndarray, np.ndarray]:
        """For each size and character its bucket (or ``1 << bits``: none), and letters per text."""
        kind, low, _ = tables()
        letter = kind[part.chars] == LETTER
        plain = np.where(letter, low[part.chars], np.uint32(32)).astype(np.uint64)
        n = len(plain)
        out = np.full((self.largest, n), 1 << self.bits, np.int32)
        value, some = np.zeros(n, np.uint64), np.zeros(n, bool)
        text_end = np.repeat(part.end, part.end - part.begin + 1)
        with np.errstate(over="ignore"):
            for size in range(1, self.largest + 1):
                m = n - size + 1
                if m <= 0:
                    break
                value = value[:m] * np.uint64(0x110001) + plain[size - 1 :]
                some = some[:m] | letter[size - 1 :]
                hashed = ((value + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
                inside = np.arange(m) + size <= text_end[:m]
                out[size - 1, :m] = np.where(inside & some, hashed.astype(np.int32), 1 << self.bits)
        return out, part.sums(letter)


def learn(docs: DataFrame, train: Column, *, max_docs: int = 20_000, counter: NgramCounter, smoothing: float = 0.5):
    """(languages, matrix) from rows where ``train`` holds and lang and text are not null.

    At most about ``max_docs`` rows are used: a documented bound.  They are chosen by a hash of
    the id, so from all of the table alike.
    """
    usable = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = min(1.0, max_docs / max(1, docs.filter(train & F.col("lang").isNotNull()).count()))
    picked = usable.filter(F.abs(F.xxhash64(F.col("doc_id"), F.lit(11)) % 1_000_003) < int(share * 1_000_003))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in smaller(batches):
            langs = np.array(batch.column(0).to_pylist(), object)
            for part in slices(batch.column(1).to_pylist()):
                grams, _ = counter.buckets(part)
                owner = np.repeat(langs[part.first : part.first + len(part.end)], part.end - part.begin + 1)
                for lang in set(owner):
                    row = total.setdefault(lang, np.zeros((1 << counter.bits) + 1, np.int64))
                    row += np.bincount(grams[:, owner == lang].ravel(), minlength=len(row))
        for lang, row in total.items():
            at = np.flatnonzero(row[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(row[at])], ["lang", "bucket", "n"])

    counts = on_workers(picked).select(F.col("lang").cast("string"), "text").mapInArrow(count, "lang string, bucket long, n long")
    sums = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    matrix = np.full(((1 << counter.bits) + 1, len(languages)), smoothing)
    for i, lang in enumerate(languages):
        own = sums[sums["lang"] == lang]
        matrix[own["bucket"].to_numpy(), i] += own["n"].to_numpy()
    matrix[-1] = 1.0  # no n-gram
    if languages:
        matrix[:-1] = np.log(matrix[:-1] / matrix[:-1].sum(axis=0))
    matrix[-1] = 0.0
    return languages, matrix.astype(np.float32)


def identify(
    docs: DataFrame,
    train: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs: int = 20_000,
    largest: int = 3,
    bits: int = 15,
) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (posterior of lang_pred, 0 to 1).

    ``train`` is a condition on ``doc_id`` that names the rows to learn from.  Texts that are null
    or have no letter get ``und`` and 0; so do all texts when nothing can be learned (an empty
    table, or no known language).  Ties go to the language first in order.  Ids may be null or
    repeat; other columns are ignored.  Very long texts are scored whole.
    """
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    counter = NgramCounter(largest, bits)
    languages, matrix = learn(source, train, max_docs=max_docs, counter=counter)
    shared = docs.sparkSession.sparkContext.broadcast(matrix)  # (2**bits + 1) x languages

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in smaller(batches):
            pred, sure = [], []
            for part in slices(batch.column(1).to_pylist()):
                grams, letters = counter.buckets(part)
                sums = np.zeros((len(part.end), len(languages)))
                for row in grams:
                    sums += np.add.reduceat(table[row], part.begin, axis=0, dtype=np.float64) if len(languages) else 0
                if not len(languages):
                    pred += [UNKNOWN] * len(letters)
                    sure += [0.0] * len(letters)
                    continue
                best = sums.argmax(axis=1)
                post = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                pred += [languages[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)]
                sure += np.where(letters > 0, post, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    id_type = source.schema["doc_id"].dataType.simpleString()
    return on_workers(source).select("doc_id", "text").mapInArrow(score, f"doc_id {id_type}, lang_pred string, score double")
