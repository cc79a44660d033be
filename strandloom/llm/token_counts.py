"""Tokens of every text, counted by rank-synchronous array merging (see ``bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import on_workers, smaller


def token_counts(
    docs: DataFrame, tokenizer_path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens.  Ids may be null or repeat; each row stands
    for itself.  Very long texts are worked off in slices.  Other columns are ignored; an empty
    table gives no rows.  Nothing is shuffled: each task streams over its own rows.
    """
    source = on_workers(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.load(tokenizer_path)
        for batch in smaller(batches):
            texts = batch.column(1).to_pylist()
            n_bytes = [0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            n_tokens = [n for _, counts, _ in words.encode(texts, with_ids=False) for n in counts.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return source.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
