"""Column functions against literal values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import hgvs as H
from strandloom.functions import quality as Q
from strandloom.functions import sequence as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sequences(spark):
    lit = F.lit
    row = spark.range(1).select(
        S.reverse_complement(lit("ACGTNacg-")).alias("rc"),
        S.lenient_reverse_complement(lit("AUZ>")).alias("lenient"),
        S.common_prefix_length(lit("ACGT"), lit("ACCT")).alias("prefix"),
        S.common_suffix_length(lit("ACGT"), lit("CGT")).alias("suffix"),
        S.tandem_prefix(lit("CA"), lit("CACACT")).alias("tandem"),
        S.tandem_prefix(lit(""), lit("CACACT")).alias("no_unit"),
        S.kmers(lit("ACGT"), 3).alias("kmers"),
        S.kmers(lit("AC"), 3).alias("none"),
        S.triplet_stats(lit("AAATTTCCCGGG")).alias("t"),
        S.longest_homopolymer(lit("TTTCCCGGG")).alias("h"),
        S.longest_homopolymer(lit("NN")).alias("h0"),
        S.translate_codons(lit("ATGGCCTAAG")).alias("protein"),
        S.leading_ns(lit("NNAN")).alias("ns"),
        S.find_position(lit("ACGT"), lit("GT")).alias("at"),
        S.cigar_end(lit(100), lit("10M2I5D3=")).alias("end"),
        S.shares_kmer(lit("ACGTACGT"), lit("TTACGTAC"), 5).alias("shares"),
    ).first()
    assert row["rc"] == "-cgtNACGT" and row["lenient"] == ">NAT"
    assert (row["prefix"], row["suffix"], row["tandem"], row["no_unit"]) == (2, 3, 5, 0)
    assert row["kmers"] == ["ACG", "CGT"] and row["none"] == []
    assert tuple(row["t"]) == (10, 10, 1.0)
    assert (row["h"]["length"], row["h"]["runs"]) == (3, ["CCC", "GGG", "TTT"]) and (row["h0"]["length"], row["h0"]["runs"]) == (0, None)
    assert row["protein"] == "MA*" and row["ns"] == 2 and row["at"] == 2 and row["end"] == 117 and row["shares"]


@pytest.mark.parametrize(
    ("pos", "ref", "alt", "kind", "name"),
    [
        (11, "A", "C", "substitution", "g.11A>C"), (40, "CAG", "C", "deletion", "g.41_42del"), (40, "CA", "C", "deletion", "g.41del"),
        (1, "TC", "C", "deletion", "g.1del"), (1, "TCAT", "T", "deletion", "g.1_3del"), (34, "G", "GA", "insertion", "g.34_35insA"),
        (1, "G", "GA", "insertion", "g.unknown"), (40, "A", "AA", "duplication", "g.40dup"), (60, "TCG", "AA", "delins", "g.60_62delinsAA"),
        (40, "AGCA", "TGCT", "inversion", "g.40_43inv"),
    ],
)
def test_vcf_names(spark, pos, ref, alt, kind, name):
    row = spark.range(1).select(H.vcf_type(F.lit(ref), F.lit(alt)).alias("k"), H.vcf_variant(F.lit(pos), F.lit(ref), F.lit(alt)).alias("n")).first()
    assert (row["k"], row["n"]) == (kind, name)


def test_hgvs(spark):
    rows = spark.createDataFrame([("c.35G>A",), ("g.35_40delinsAA",), ("c.7_8insT",), ("c.5dup",), ("c.1_4inv",), ("c.9del",), ("x",), (None,)], "v string")
    found = [tuple(r) for r in rows.select(H.variant_start("v"), H.variant_end("v"), H.variant_type("v")).collect()]
    assert found == [
        (35, 35, "substitution"), (35, 40, "delins"), (7, 8, "insertion"), (5, 5, "duplication"), (1, 4, "inversion"), (9, 9, "deletion"),
        (None, None, "unknown"), (None, None, "unknown"),
    ]
    assert one(spark, H.header_type(F.lit("a:c.1A>C;b:c.2A>C"))) == "substitution"
    assert one(spark, H.header_type(F.lit("a:c.1A>C;b:c.2del"))) == "mixed"
    assert one(spark, H.plain_seq_id(F.lit("1.0"))) == "1" and one(spark, H.fasta_id(F.lit("ENST1.4 cdna x"))) == "ENST1"
    assert one(spark, H.repair_strand(F.lit("g.5A>C"), F.lit("-"))) == "g.5T>G"
    assert one(spark, H.header_with_gene(F.lit("E1:c.1A>C"), F.lit("TP53"))) == "E1(TP53):c.1A>C"


def test_quality(spark):
    row = spark.range(1).select(
        Q.mask_low_quality(F.lit("ACGT"), F.lit("I!I#"), 13).alias("m"), Q.mean_quality(F.lit("I!")).alias("q"), Q.unqualified_share(F.lit("I!I#"), 13).alias("u"),
        Q.cut_window_tail(F.lit("ACGTAC"), F.lit("IIII!!"), 2, 20).alias("cut"), Q.barcode(F.lit("AACCGGTT"), [(0, 2), (4, 6)]).alias("b"),
        Q.sensitivity(F.lit(0), F.lit(0)).alias("sens"), Q.precision(F.lit(0), F.lit(0)).alias("prec"),
    ).first()
    assert row["m"] == "ANGN" and row["q"] == 20.0 and row["u"] == 0.5 and row["cut"] == 4 and row["b"] == "AAGG"
    assert (row["sens"], row["prec"]) == (1.0, 0.0)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("ACGTN", max_size=40), min_size=1, max_size=8))
def test_reverse_complement_is_its_own_inverse(spark, seqs):
    rows = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", S.reverse_complement(S.reverse_complement("s")).alias("t")).collect()
    assert all(r["s"] == r["t"] for r in rows)


def test_sql_functions(spark):
    S.register_sql(spark)
    row = spark.sql("SELECT revcomp('AAC') AS a, kmers('ACGT', 3) AS k, hgvs_positions('c.35_36del') AS p, hgvs_change('c.35_36del') AS c").first()
    assert tuple(row) == ("GTT", ["ACG", "CGT"], "35_36", "del")
