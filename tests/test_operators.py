"""Operators against literal values (of FIXTURES.md) and against each other."""

import pytest
from pyspark.sql import functions as F

from strandloom.operators import counts as C
from strandloom.operators import filters as FL
from strandloom.operators import info as I
from strandloom.operators import kmers as K
from strandloom.operators import ranges as R
from strandloom.operators import reads as RD
from strandloom.operators import simulate as SIM


def test_kmer_overlap(spark):
    df = spark.createDataFrame([(1, "ATCGATCGATCG"), (2, "GCTAGCTAGCTA"), (3, "GATCTTTGCTA"), (4, "TTTTTTTTTT")], "id int, sequence string")
    got = K.kmer_overlaps(df, 4, True).orderBy("id").collect()
    assert [r["kmers"] for r in got] == [2, 3, 2, 0] and [len(r["others"]) for r in got] == [1, 1, 2, 0]


def test_nearby(spark):
    df = spark.createDataFrame([("s", 10, 10, "a"), ("s", 15, 16, "b"), ("s", 19, 19, "c"), ("s", 300, 300, "d"), ("t", 15, 15, "e")], "seq_id string, start int, end int, header string")
    got = {r["header"]: r["nearby_variants"] for r in R.nearby_variants(df, 10).collect()}
    assert got == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"], "d": [], "e": []}


def test_splice_distance(spark):
    marks = spark.createDataFrame([("1", p) for p in (100, 200, 300)] + [("2", p) for p in (150, 250, 350)], "seq_id string, position int")
    v = spark.createDataFrame([("1", 105, 105), ("2", 140, 140), ("1", 290, 290), ("2", 148, 149), ("1", 200, 201), ("2", 550, 551), ("3", 5, 5)], "seq_id string, start int, end int")
    got = {(r["seq_id"], r["start"]): (r["distance_to_nearest_splice_junction"], r["is_near_splice_junction_10"]) for r in R.nearest_junction(v, marks).collect()}
    assert got == {("1", 105): (5, True), ("2", 140): (10, True), ("1", 290): (10, True), ("2", 148): (1, True), ("1", 200): (0, True), ("2", 550): (200, False), ("3", 5): (None, None)}


def test_pseudoalignment(spark):
    a, b = "ACGTACCTGA", "TTGCATGCCA"
    targets = spark.createDataFrame([("t1", a + "GG"), ("t2", a + "CC"), ("t3", b)], "id string, sequence string")
    index = K.kmer_index(targets, 5, True)
    reads = spark.createDataFrame([(1, a), (2, a + "GG"), (3, b), (4, "GGGGGGGGGG"), (5, a + b)], "read_index int, sequence string")
    meet = {r["read_index"]: r["targets"] for r in K.pseudoalign(reads, index, 5, stranded=True).collect()}
    join = {r["read_index"]: r["targets"] for r in K.pseudoalign(reads, index, 5, stranded=True, union=True).collect()}
    assert meet == {1: ["t1", "t2"], 2: ["t1"], 3: ["t3"]}
    assert join == {1: ["t1", "t2"], 2: ["t1", "t2"], 3: ["t3"], 5: ["t1", "t2", "t3"]}


def test_counts(spark):
    reads = spark.createDataFrame(
        [("c1", "u1", ["a", "b"]), ("c1", "u1", ["a"]), ("c1", "u2", ["a"]), ("c1", "u3", ["b", "c"]), ("c2", "u1", ["c"])],
        "barcode string, umi string, targets array<string>",
    )
    got = lambda m: {(r["barcode"], r["vcrs_id"]): r["count"] for r in m.collect()}
    assert got(C.count_matrix(reads, umis=True)) == {("c1", "a"): 2, ("c2", "c"): 1}
    assert got(C.count_matrix(reads, umis=True, multimapping=True)) == {("c1", "a"): 2, ("c1", "b"): 0.5, ("c1", "c"): 0.5, ("c2", "c"): 1}
    assert got(C.count_matrix(reads, umis=False)) == {("c1", "a"): 2, ("c2", "c"): 1}


def test_recount(spark):
    reads = spark.createDataFrame([("x", 1, ["v1"]), ("x", 2, ["v2"]), ("x", 3, ["v1", "v2"]), ("x", 4, ["v2"])], "barcode string, read_index int, targets array<string>")
    genome = spark.createDataFrame([("x", 1, ["g1"]), ("x", 2, ["g1"]), ("x", 3, ["g1"])], "barcode string, read_index int, genes array<string>")
    genes = spark.createDataFrame([("v1", ["g1"]), ("v2", ["g2"])], "vcrs_id string, genes array<string>")
    got = {r["vcrs_id"]: r["count"] for r in C.recount_by_genome(reads, genome, genes).collect()}
    assert got == {"v1": 2.0, "v2": 1.0}
    assert {r["vcrs_id"]: r["count"] for r in C.recount_by_genome(reads, genome, genes, count_unaligned=False).collect()} == {"v1": 2.0}
    doubted = C.recount_by_genome(reads, genome, genes, mistake_ratio=0.5, multimapping=True)
    assert {r["vcrs_id"]: r["count"] for r in doubted.collect()} == {"v1": 2.0, "v2": 3.0}


def test_barcodes(spark):
    reads = spark.createDataFrame([(1, "ACGT"), (2, "ACGA"), (3, "TTTT")], "read_index int, barcode string")
    listed = spark.createDataFrame([("ACGT",), ("CCGA",)], "barcode string")
    assert {r["read_index"]: r["barcode"] for r in C.rescue_barcodes(reads, listed).collect()} == {1: "ACGT", 2: "CCGA"}


@pytest.mark.parametrize("text", ["a", "a:nope", "a:greater_than", "a:greater_than=x", "a:is_null=1", "a:between_inclusive=5,2", "a:is_in=3", "a:top_percent=200"])
def test_bad_filters(text):
    with pytest.raises(ValueError, match="."):
        FL.parse_filters(text)


def test_filters_and_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, None, None), (3, 5.0, False), (4, 9.0, True)], "id int, x double, b boolean")
    ids = lambda *f: sorted(r["id"] for r in FL.apply_filters(df, list(f)).collect())
    assert ids("x:greater_than=4") == [2, 3, 4] and ids("x:less_or_equal=5") == [1, 2, 3] and ids("x:equal=5.0") == [3]
    assert ids("x:not_equal=5.0") == [1, 2, 4] and ids("b:is_true") == [1, 4] and ids("b:is_not_true") == [2, 3] and ids("b:is_not_false") == [1, 2, 4]
    assert ids("x:is_in=[1.0, 9.0]") == [1, 4] and ids("x:is_not_in=[1.0]") == [2, 3, 4] and ids("x:is_null") == [2]
    assert ids("x:top_percent=50") == [2, 3, 4] and ids("x:bottom_percent=50") == [1, 2, 3] and ids("nothing:is_true") == [1, 2, 3, 4]


def test_explode_and_collapse(spark):
    df = spark.createDataFrame([("a:c.1A>C;b:c.2A>C", "ACGT"), ("c:c.3A>C", "GGGG")], "vcrs_header string, vcrs_sequence string")
    long = I.explode_headers(df)
    assert long.count() == 3
    back = {r["vcrs_header"]: (r["vcrs_header_individual"], r["vcrs_sequence"]) for r in I.collapse(long, ["vcrs_header_individual"]).collect()}
    assert back == {"a:c.1A>C;b:c.2A>C": (["a:c.1A>C", "b:c.2A>C"], "ACGT"), "c:c.3A>C": (["c:c.3A>C"], "GGGG")}


def test_split_at_n(spark):
    df = spark.createDataFrame([("r", "ACNNGTTNA", "IIIIIIIII"), ("s", "ACGT", "IIII"), ("t", "NNNN", "IIII")], "header string, sequence string, quality string")
    got = sorted((r["header"], r["sequence"], r["quality"]) for r in RD.split_at_n(df, 2).collect())
    assert got == [("r:0-2", "AC", "II"), ("r:4-7", "GTT", "III"), ("s:1-4", "ACGT", "IIII")]


def test_simulated_reads_are_slices(spark):
    parents = spark.createDataFrame([("v1", "ACGTACGGTTACGA"), ("v2", "ACG")], "vcrs_id string, sequence string")
    every = SIM.every_read(parents, 10, "both")
    assert every.count() == 10
    seq = "ACGTACGGTTACGA"
    turn = str.maketrans("ACGT", "TGCA")
    for reads in (every, SIM.sampled_reads(parents, 10, 7), SIM.sampled_reads(parents, 10, 3, with_replacement=False)):
        for r in reads.collect():
            part = seq[r["start"] : r["start"] + 10]
            assert r["sequence"] == (part if r["strand"] == "f" else part.translate(turn)[::-1])
    assert SIM.sampled_reads(parents, 10, 3, with_replacement=False).select("start").distinct().count() == 3
    assert SIM.sequencing_errors(every, rate=0.0).select("sequence").exceptAll(every.select("sequence")).count() == 0
    assert SIM.noisy_quality(every).filter(F.length("quality") == F.length("sequence")).count() == 10


def test_sequencing_errors(spark):
    reads = spark.createDataFrame([(f"r{i}", "ACGT" * 50) for i in range(200)], "read_id string, sequence string")
    count = lambda df: df.select(F.sum(F.levenshtein("sequence", F.repeat(F.lit("ACGT"), 50)))).first()[0]
    plain = SIM.sequencing_errors(reads, rate=0.01, shares=(1.0, 0.0, 0.0))
    assert 300 < count(plain) < 500 and plain.filter("length(sequence) <> 200").count() == 0
    assert plain.exceptAll(SIM.sequencing_errors(reads.repartition(7), rate=0.01, shares=(1.0, 0.0, 0.0))).count() == 0
    assert SIM.sequencing_errors(reads, rate=0.5, shares=(0.0, 0.0, 0.0)).select(F.avg(F.length("sequence"))).first()[0] < 110
    one = SIM.sequencing_errors(reads, rate=0.1, shares=(1.0, 0.0, 0.0), max_errors=1)
    assert one.select(F.max(F.levenshtein("sequence", F.repeat(F.lit("ACGT"), 50)))).first()[0] == 1 and count(one) == 200
    assert count(SIM.sequencing_errors(reads, rate=0.1, max_errors=0)) == 0


def test_build_count_round_trip(spark):
    """Reads of a sequence are assigned to it, whatever the partitioning."""
    targets = spark.createDataFrame([("v1", "ACGTACGGTTACGATTGCA"), ("v2", "TTGCCCATGACCAGTGGAC")], "id string, sequence string")
    reads = SIM.every_read(targets.withColumnRenamed("id", "vcrs_id"), 12, "both").withColumnRenamed("read_id", "read_index")
    for n in (1, 5):
        got = K.pseudoalign(reads.repartition(n), K.kmer_index(targets, 7), 7)
        assert got.filter(F.col("targets")[0] == F.substring("read_index", 1, 2)).count() == reads.count() == got.count()
