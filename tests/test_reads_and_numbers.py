"""FASTQ over splits and files, numbering by ranges: against plain versions."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import number as N
from strandloom.sources import fastq
from strandloom.sources.readers import read_fastq

RNG = random.Random(4)


def record(name, n):
    bases = "".join(RNG.choice("ACGTN") for _ in range(n))
    quality = "".join(chr(RNG.randint(33, 73)) for _ in range(n))
    return name, bases, "@" + quality[1:] if n and RNG.random() < 0.3 else quality  # qualities that begin like headers


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("fastq")
    want = []
    for name, reads in (("a.fastq", 700), ("b.fastq", 1000), ("c.fastq.gz", 50), ("d.fastq", 0), ("e.fastq", 3)):
        rows = [record(f"{name}_{i} x", RNG.choice([0, 1, 30, 151, 400])) for i in range(reads)]
        rows += [record("long", 20_000)] if name == "b.fastq" else []
        text = "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in rows)
        (gzip.open if name.endswith("gz") else open)(top / name, "wt").write(text[:-1] if name == "e.fastq" else text)
        want += rows
    return top, [(i, *r) for i, r in enumerate(want)]


@pytest.mark.parametrize("size", ["1k", "3001", "64k", "128m"])
@pytest.mark.parametrize("few", [True, False])
def test_records_over_splits_and_files(spark, folder, size, few, monkeypatch):
    top, want = folder
    monkeypatch.setattr(fastq, "BROADCAST_SPLITS", 100_000 if few else 0)
    for key, value in (("spark.sql.files.maxPartitionBytes", size), ("spark.sql.files.openCostInBytes", "100"), ("spark.sql.files.minPartitionNum", "3")):
        spark.conf.set(key, value)
    try:
        rows = read_fastq(spark, str(top))
        got = sorted((r["read_index"], r["header"], r["sequence"], r["quality"]) for r in rows.collect())
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
            spark.conf.unset(key)
    assert got == want


def test_cut_and_blank_ends(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1\nAC\n+\nII\n@r2\nGG\n")
    (tmp_path / "b.fastq").write_text("@r3\r\nAC\r\n+\r\nII\r\n\n\n")
    got = sorted(tuple(r)[1:] for r in read_fastq(spark, [str(tmp_path / "b.fastq"), str(tmp_path / "a.fastq")]).collect())
    assert got == [(0, "r1", "AC", "II"), (1, "r2", "GG", None), (2, "r3", "AC", "II")]


def test_numbers_in_order_of_a_column_of_three_values(spark):
    rows = [(i % 3, RNG.choice([None, "x", "y", "zz"]), RNG.random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, c double, i int").repartition(5)
    got = N.ranked(df, "a", F.desc("b"), "c", name="n", ranges=16).withColumn("task", F.spark_partition_id())
    order = sorted(rows, key=lambda r: (r[0], tuple(-ord(x) for x in r[1]) if r[1] else (1,), r[2]))
    assert {r["i"]: r["n"] for r in got.collect()} == {r[3]: n for n, r in enumerate(order, 1)}
    # ranges are even although the first column has three values only
    dealt = df.repartitionByRange(16, "a", "c").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(dealt) > 12 and max(r["count"] for r in dealt) < 600


def test_numbered_ids(spark):
    df = spark.createDataFrame([(i,) for i in range(12, 0, -1)], "v int")
    got = {r["v"]: r["vcrs_id"] for r in N.numbered(df, "v").collect()}
    assert got == {i: f"vcrs_{i:02d}" for i in range(1, 13)}
    assert N.numbered(df.limit(0), "v").count() == 0
