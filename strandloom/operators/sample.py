"""Exact samples: as many rows as asked for, the same ones for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import materialised
from .number import ranked

#: Bits of the hash that one counting pass tells apart, and rows of the last bucket that are sorted.
BITS, SMALL = 16, 10_000


def draw(seed: int, *columns: Column | str) -> Column:
    """A number from 0 to 1 (exclusive) that depends on these columns and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) / float(1 << 53)


def exact_sample(rows: DataFrame, n: int, *keys: str, seed: int = 42, code: Column | None = None) -> DataFrame:
    """``n`` of ``rows`` (all, if there are fewer), drawn without replacement by a hash of ``keys``, which name a row (or by ``code``, a long).

    The n smallest hashes are found by their leading bits: each pass counts 2**16 buckets of the bucket in which the
    n-th hash lies.  Only a small last bucket is sorted; every row before it is in.
    """
    hashed = rows.withColumn("_h", F.xxhash64(*keys, F.lit(seed)) if code is None else code)
    low, left, shift = -(1 << 63), n, 64  # hashes from ``low`` on, of which ``left`` are wanted, agree above ``shift`` bits
    while shift > 0:
        inside = hashed.filter((F.col("_h") >= low) & (F.col("_h") <= low + (1 << shift) - 1)) if shift < 64 else hashed
        bucket = F.shiftright("_h", shift - BITS)
        counts = sorted(map(tuple, inside.groupBy(bucket.alias("b")).count().collect()))  # 2**16 rows at most
        for b, size in counts:
            if size >= left:
                break
            left -= size
        else:
            return rows  # fewer than n
        low, shift = b << (shift - BITS), shift - BITS
        if size <= SMALL:
            break
    border = hashed.filter((F.col("_h") >= low) & (F.col("_h") <= low + (1 << shift) - 1))
    taken = hashed.filter(F.col("_h") < low).unionByName(border.orderBy("_h", *keys).limit(left))
    return taken.drop("_h")


def exact_sample_with_replacement(rows: DataFrame, n: int, *keys: str, seed: int = 42, name: str = "times") -> DataFrame:
    """The rows that ``n`` draws with replacement hit, with how often; ``keys`` name a row.

    Draws are numbers of rows in the order of ``keys``: a table of n rows at most meets the numbered rows.
    """
    numbered = materialised(ranked(rows, *keys, name="_rank"))
    total = numbered.count()
    draws = rows.sparkSession.range(n if total else 0).select((F.floor(draw(seed, "id") * total) + 1).alias("_rank"))
    return numbered.join(draws.groupBy("_rank").agg(F.count("*").alias(name)), "_rank").drop("_rank")
