"""Exact samples, sums and neighbours along an order, background reads, the knee: against plain versions."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import counts as C
from strandloom.operators import number as N
from strandloom.operators import sample as SA
from strandloom.operators import simulate as SIM

RNG = random.Random(21)


@pytest.mark.parametrize("small", [10_000, 5])
def test_exact_samples_for_any_partitioning(spark, monkeypatch, small):
    monkeypatch.setattr(SA, "SMALL", small)
    df = spark.range(3000).withColumn("x", F.col("id") % 7)
    for n in (0, 1, 17, 2999, 3000, 5000):
        got = [{r["id"] for r in SA.exact_sample(df.repartition(p), n, "id").collect()} for p in (1, 6)]
        assert len(got[0]) == min(n, 3000) and got[0] == got[1]
    one, two = ({r["id"] for r in SA.exact_sample(df, 500, "id", seed=s).collect()} for s in (1, 2))
    assert 30 < len(one & two) < 140  # a sixth of 500 is expected


def test_exact_samples_with_replacement(spark):
    df = spark.range(50).withColumn("x", F.col("id") % 7)
    got = [sorted(map(tuple, SA.exact_sample_with_replacement(df.repartition(p), 400, "id").collect())) for p in (1, 5)]
    assert got[0] == got[1] and sum(t for *_, t in got[0]) == 400 and len(got[0]) > 40
    assert SA.exact_sample_with_replacement(df.limit(0), 5, "id").count() == 0


def test_running_totals_and_last_marks(spark):
    rows = [(RNG.randint(0, 200), RNG.randint(0, 5), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, n int, i int").repartition(3)
    got = {r["i"]: r["total"] for r in N.running_totals(df, "n", "a", "i", ranges=9).collect()}
    total = 0
    for a, n, i in sorted(rows, key=lambda r: (r[0], r[2])):
        assert got[i] == total
        total += n
    marks = sorted(RNG.sample(range(10, 300), 40))
    table = spark.createDataFrame([(m, f"m{m}") for m in marks], "a int, name string")
    for ranges in (1, 13):
        near = {r["i"]: r["name"] for r in N.last_before(df, table, "a", ranges=ranges).collect()}
        for a, _, i in rows:
            at = bisect.bisect_right(marks, a)
            assert near[i] == (f"m{marks[at - 1]}" if at else None)


def test_background_reads_are_exact_and_free(spark):
    seqs = [(f"s{i}", "".join(RNG.choice("ACGT") for _ in range(n))) for i, n in enumerate([9000, 500, 30, 29, 0, 12000])]
    ranges = [("s0", a, a + RNG.randint(0, 40)) for a in (RNG.randrange(8000) for _ in range(60))] + [("s0", -5, 10), ("s1", 0, 480), ("s5", 11_000, 99_999), ("x", 1, 2)]
    ref, spots = spark.createDataFrame(seqs, "seq_id string, sequence string"), spark.createDataFrame(ranges, "seq_id string, start int, end int")
    reads = SIM.background_reads(ref, spots, 700, 30).collect()
    text = dict(seqs)
    assert len(reads) == 700 and len({r["read_id"] for r in reads}) == 700
    for r in reads:
        assert r["sequence"] == text[r["seq_id"]][r["start"] : r["start"] + 30] and len(r["sequence"]) == 30
        assert not any(q == r["seq_id"] and s < r["start"] + 30 and e >= r["start"] for q, s, e in ranges)
    free = {(q, a) for q, s in seqs for a in range(len(s) - 29) if not any(q == x and b < a + 30 and e >= a for x, b, e in ranges)}
    found = SIM.free_starts(ref.select("seq_id", F.length("sequence").alias("length")), spots, 30).collect()
    assert {(r["seq_id"], r["first"] + i) for r in found for i in range(r["n"])} == free
    assert {"s0", "s5"} <= {r["seq_id"] for r in reads} <= {"s0", "s2", "s5"}
    assert SIM.background_reads(ref.limit(0), spots, 5, 30).count() == 0


def test_the_knee_of_all_totals(spark):
    totals = sorted((int(10_000 / (1 + i / 20) ** 2) + RNG.randint(1, 9) for i in range(400)), reverse=True)
    cells = spark.createDataFrame([(f"b{i:03d}", "v", float(t)) for i, t in enumerate(totals)], "barcode string, vcrs_id string, count double").repartition(5)
    high, low = totals[0], totals[-1]
    gaps = [(1 - i / 399) - (t - low) / (high - low) for i, t in enumerate(totals)]
    assert C.knee(cells) == totals[gaps.index(max(gaps))]
    assert C.knee(cells.limit(0)) == 0.0 and C.knee(cells.withColumn("count", F.lit(3.0))) == 3.0


def test_shares_of_a_set_and_ranks(spark):
    rows = [("a", "m1", 3.0), ("a", "v", 1.0), ("b", "v", 2.0), ("c", "m1", 0.0), ("d", "m2", 5.0), ("d", "v", 5.0), ("d", "w", 1.0)]
    df, mito = spark.createDataFrame(rows, "barcode string, vcrs_id string, count double"), spark.createDataFrame([("m1",), ("m2",), ("m2",)], "vcrs_id string")
    assert {r["barcode"]: round(r["share"], 4) for r in C.set_share(df, mito).collect()} == {"a": 0.75, "b": 0.0, "c": 0.0, "d": 0.4545}
    kept = C.quality_filter(df, mitochondrial=mito, max_mitochondrial=0.5)
    assert {r["barcode"] for r in kept.collect()} == {"b", "c", "d"}
    assert {(r["barcode"], r["vcrs_id"], r["rank"]) for r in C.variant_ranks(df, 2).collect()} == {("a", "m1", 1), ("a", "v", 2), ("b", "v", 1), ("d", "m2", 1), ("d", "v", 2)}
