"""Building: literal sequences, drop reasons, VCF records and merging (values of FIXTURES.md)."""

import re
from collections import defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from strandloom.operators.build import BuildOptions, build, merge_identical
from strandloom.operators.number import numbered

TEXT = (Path(__file__).parents[1] / "FIXTURES.md").read_text()
SEQUENCES = {n: re.search(rf"`{n}` = `([A-Z]+)`", TEXT)[1] for n in ("long_sequence", "extra_long_sequence", "long_sequence_with_N")}
REASONS = {"intronic": "intronic", "posttranslational": "posttranslational", "uncertain": "uncertain", "ambiguous": "ambiguous_position", "index": "outside", "incorrect": "wrong_wild_type_base"}


def test_single_variants(spark):
    rows = re.findall(r"^\| \d+ \| (\w+) \| `([^`]+)` \| (\d+)/(\d+) \| ([^|]+) \| `([^`]+)` \|", TEXT, re.M)
    assert len(rows) == 32
    groups = defaultdict(list)
    for seq, variant, w, k, options, expected in rows:
        groups[w, k, options.strip()].append((seq, variant, expected))
    sequences = spark.createDataFrame(list(SEQUENCES.items()), "seq_id string, sequence string")
    for (w, k, options), cases in groups.items():
        o = BuildOptions(
            w=int(w), k=int(k), min_seq_len=100 if "min_seq_len" in options else None,
            optimize_flanks="optimize_flanking_regions=False" not in options, remove_wild_type_kmers="remove_seqs_with_wt_kmers=False" not in options,
        )
        built = build(spark.createDataFrame([c[:2] for c in cases], "seq_ID string, mutation string"), sequences, o)
        got = {r["header"]: r["vcrs_sequence"] for r in built.variants.collect()}
        why = {r["header"]: r["drop_reason"] for r in built.checked.collect()}
        for seq, variant, expected in cases:
            header = f"{seq}:{variant}"
            if re.fullmatch("[ACGTN]+", expected):
                assert got.get(header) == expected, header
            else:
                assert header not in got and why[header]
                for word, reason in REASONS.items():
                    assert word not in expected or why[header] == reason, header


def test_vcf_rows(spark):
    seq = re.search(r"sequence 19 = `([A-Z]+)`", TEXT)[1]
    rows = re.findall(r"^\| `19:(g\.[^`]+)` \| (\w+) \| `([A-Z]+)` \| `([A-Z]+)` \| (vcrs_\d+) \|", TEXT, re.M)
    assert len(rows) == 15
    variants = spark.createDataFrame([(i, "19", r[0]) for i, r in enumerate(rows)], "original_order long, seq_ID string, mutation string")
    o = BuildOptions(w=6, k=7, optimize_flanks=False, remove_wild_type_kmers=False, min_seq_len=0, merge_identical=False, max_ambiguous=None)
    built = build(variants, spark.createDataFrame([("19", seq)], "seq_id string, sequence string"), o)
    got = {r["header"]: (r["variant_type"], r["wt_sequence"], r["vcrs_sequence"]) for r in built.variants.collect()}
    ids = {r["vcrs_header"]: r["vcrs_id"] for r in built.vcrs.collect()}
    for name, kind, wt, mutant, vcrs_id in rows:
        assert got[f"19:{name}"] == (kind, wt, mutant) and ids[f"19:{name}"] == vcrs_id


def test_merging(spark):
    rows = [("header1", "AAAAAA", 0), ("header2", "AAAAAA", 1), ("header3", "GGGGGGG", 2), ("header4", "CCCCCCC", 3), ("aheader5", "AAAAAA", 4), ("header6", "CCCCCCC", 5)]
    df = spark.createDataFrame(rows, "header string, vcrs_sequence string, original_order long")
    plain = {(r["vcrs_header"], r["vcrs_sequence"]) for r in merge_identical(df, False).collect()}
    assert plain == {("aheader5;header1;header2", "AAAAAA"), ("header4;header6", "CCCCCCC"), ("header3", "GGGGGGG")}
    both = numbered(merge_identical(df, True), "vcrs_sequence").orderBy("vcrs_id").collect()
    assert [(r["vcrs_id"], r["vcrs_header"], r["vcrs_sequence"]) for r in both] == [("vcrs_1", "aheader5;header1;header2", "AAAAAA"), ("vcrs_2", "header3;header4;header6", "GGGGGGG")]


def test_numbers_have_no_gaps(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1009).alias("v"))
    got = numbered(df, "v").select("v", "vcrs_id").orderBy("v").collect()
    assert [r["vcrs_id"] for r in got] == [f"vcrs_{i:04d}" for i in range(1, 1001)]
