"""The verbs clean, sim, fastqpp and build with all they offer, on the command line."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.plans import verbs as V
from strandloom.sources import readers as R
from strandloom.sources import writers as W

RNG = random.Random(31)
TURN = str.maketrans("ACGT", "TGCA")


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def bases(n):
    return "".join(RNG.choice("ACGT") for _ in range(n))


def fastq(reads):
    return "".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(reads))


def test_pairs_with_adapters(spark, tmp_path):
    adapter, inserts = "AGATCGGAAGAGCACACGTCTGAACT", [bases(RNG.choice([45, 60, 200])) for _ in range(40)]
    ends = [(x + adapter + bases(80), x[::-1].translate(TURN) + adapter + bases(80)) for x in inserts]
    one, two = put(tmp_path, "1.fastq", fastq(a[:80] for a, _ in ends)), put(tmp_path, "2.fastq", fastq(b[:80] for _, b in ends))
    out = str(tmp_path / "out")
    cli.main(["fastqpp", "--fastq", one, "--mates", two, "--out", out, "--min-length", "50", "--profile"], spark)
    got = [{r["header"]: r["sequence"] for r in R.read_fastq(spark, f"{out}/reads_{i}.fastq").collect()} for i in (1, 2)]
    want = {f"r{i}": x for i, x in enumerate(inserts) if len(x) >= 50}
    assert got[0] == {h: x[:80] for h, x in want.items()} and got[1] == {h: x[::-1].translate(TURN)[:80] for h, x in want.items()}
    assert spark.read.parquet(f"{out}/profile.parquet").count() == 80
    cli.main(["fastqpp", "--fastq", one, "--out", out + "2", "--adapter", adapter], spark)
    alone = {r["header"]: r["sequence"] for r in R.read_fastq(spark, f"{out}2/reads.fastq").collect()}
    assert alone == {f"r{i}": x[:80] for i, x in enumerate(inserts)}


def test_simulated_variants(spark, tmp_path):
    rows = [(f"v{i:02d}", f"s:c.{i}A>C", bases(60), bases(60), i % 3) for i in range(30)]
    table = str(tmp_path / "v.parquet")
    spark.createDataFrame(rows, "vcrs_id string, vcrs_header string, vcrs_sequence string, wt_sequence string, kind int").write.parquet(table)
    out = str(tmp_path / "out")
    common = ["sim", "--vcrs", table, "--read-length", "40", "--wild-type", "wt_sequence", "--variants", "7", "--filters", "kind:less_than=2"]
    cli.main([*common, "--reads", "5", "--wild-type-reads", "3", "--out", out], spark)
    made = spark.read.parquet(f"{out}/simulated.parquet").collect()
    assert len(made) == 7 and {(r["number_of_reads_mutant"], r["number_of_reads_wt"], r["tumor_purity"]) for r in made} == {(5, 3, 0.625)}
    assert all(r["kind"] < 2 and len(r["list_of_read_starting_indices_mutant"]) == 5 for r in made)
    reads = spark.read.parquet(f"{out}/reads.parquet")
    assert reads.count() == 56 and {r["vcrs_id"] for r in reads.collect()} == {r["vcrs_id"] for r in made}
    cli.main([*common, "--out", out + "2", "--without", f"{out}/simulated.parquet"], spark)
    assert not {r["vcrs_id"] for r in spark.read.parquet(f"{out}2/simulated.parquet").collect()} & {r["vcrs_id"] for r in made}


def test_cleaning_of_cells(spark, tmp_path):
    rows = [(f"c{c}", f"v{v}", float((c + 1) * (v + 1))) for c in range(6) for v in range(4)] + [("c9", "v3", 50.0), ("c8", "v0", 1.0)]
    counts = str(tmp_path / "counts.parquet")
    spark.createDataFrame(rows, "barcode string, vcrs_id string, count double").write.parquet(counts)
    vcrs = str(tmp_path / "vcrs.parquet")
    spark.createDataFrame([(f"v{v}", f"T{v}:c.{v + 5}A>C") for v in range(4)], "vcrs_id string, vcrs_header string").write.parquet(vcrs)
    t2g = put(tmp_path, "t2g.tsv", "".join(f"T{v}\tG{v}\n" for v in range(4)))
    vcf = put(tmp_path, "in.vcf", "#CHROM\tPOS\tID\tREF\tALT\n" + "".join(f"1\t{v + 5}\tT{v}:c.{v + 5}A>C\tA\tC\n" for v in range(4)))
    out = str(tmp_path / "out")
    cli.main([
        "clean", "--counts", counts, "--vcrs", vcrs, "--t2g", t2g, "--out", out, "--min-counts", "2", "--cell-min-counts", "25", "--mitochondrial", put(tmp_path, "mt.txt", "G3\n"),
        "--max-mitochondrial", "0.5", "--exclude-genes", put(tmp_path, "ex.txt", "G1\n"), "--vcf", vcf, "--matrix-market",
    ], spark)
    # c9 has mitochondrial counts only; c0 and c1 have fewer than 25 counts
    kept = {(b, v, n) for b, v, n in rows if b in ("c2", "c3", "c4", "c5") and v != "v1"}
    assert {tuple(r) for r in spark.read.parquet(f"{out}/counts.parquet").select("barcode", "vcrs_id", "count").collect()} == kept
    found = {r["ID"]: (r["POS"], r["INFO"]["AO"], r["INFO"]["NS"]) for r in R.read_vcf(spark, f"{out}/variants.vcf").collect()}
    assert found == {f"T{v}:c.{v + 5}A>C": (v + 5, str(18 * (v + 1)), "4") for v in (0, 2, 3)}
    back = R.read_matrix_market(spark, f"{out}/matrix_market/matrix.mtx", f"{out}/matrix_market/barcodes.txt", f"{out}/matrix_market/genes.txt")
    assert {tuple(r) for r in back.collect()} == kept
    cli.main(["clean", "--counts", counts, "--out", out + "2", "--sum", "--keep", put(tmp_path, "keep.txt", "v3\n")], spark)
    assert spark.read.parquet(f"{out}2/totals.parquet").first()["vcrs_count"] == 134.0
    ranks = V.summarize(spark.read.parquet(counts), 2, ranks=True)["top_per_sample"]
    assert {(r["vcrs_id"], r["rank"]) for r in ranks.filter("barcode = 'c2'").collect()} == {("v3", 1), ("v2", 2)}


def test_double_counts(spark):
    matrix = spark.createDataFrame([("b", "v1", 3.0), ("b", "v2", 2.0)], "barcode string, vcrs_id string, count double")
    reads = [("b", "r1:0-30", 1, ["v1"], True), ("b", "r1:35-70", 1, ["v1"], True), ("b", "r2:1-9", 1, ["v1"], True), ("b", "r3:1-9", 2, ["v2"], True)]
    reads = spark.createDataFrame(reads, "barcode string, fastq_header string, ec int, targets array<string>, counted_in_count_matrix boolean")
    got = V.clean(matrix, min_counts=0, reads=reads, split_at_n=True)[0]
    assert {(r["vcrs_id"], r["count"]) for r in got.collect()} == {("v1", 2.0), ("v2", 2.0)}


def test_headers_out_of_reach_go(spark):
    vcrs = spark.createDataFrame([("v1", "T1:c.50G>A;T2:c.5001G>A", 1), ("v2", "T1:c.9000A>C", 2)], "vcrs_id string, vcrs_header string, x int")
    lengths = spark.createDataFrame([("T1", 0, 10_000), ("T2", 0, 10_000)], "transcript_id string, utr5 int, transcript_length int")
    assert [tuple(r) for r in V.reachable(vcrs, lengths, "10xv2", 100, "5p").collect()] == [("v1", "T1:c.50G>A", 1)]
    assert V.reachable(vcrs, lengths, "bulk", 100).count() == 2


def test_building_from_vcf_and_gtf(spark, tmp_path):
    seq = bases(400)
    fasta = put(tmp_path, "s.fa", f">19\n{seq}\n")
    vcf = put(tmp_path, "a.vcf", f"#CHROM\tPOS\tID\tREF\tALT\nchr19\t100\t.\t{seq[99]}\t{'ACGT'['ACGT'.index(seq[99]) - 1]}\nchr19\t900\t.\tA\tC\n")
    out = str(tmp_path / "out")
    cli.main(["build", "--variants", vcf, "--sequences", fasta, "--out", out, "-w", "20", "-k", "21"], spark)
    assert spark.read.parquet(f"{out}/vcrs.parquet").count() == 1
    assert [r["value"] for r in spark.read.text(f"{out}/removed.txt").collect()] == ["19:g.900A>C"]
    gtf = put(tmp_path, "a.gtf", 'x\te\ttranscript\t91\t300\t.\t+\t.\tgene_id "G"; transcript_id "19";\n')
    table = put(tmp_path, "v.csv", f"seq_ID,mutation\n19,c.100{seq[99]}>{'ACGT'['ACGT'.index(seq[99]) - 1]}\n")
    cli.main(["build", "--variants", table, "--sequences", fasta, "--out", out + "2", "-w", "20", "-k", "21", "--gtf", gtf], spark)
    assert len(spark.read.parquet(f"{out}2/vcrs.parquet").first()["vcrs_sequence"]) == 30  # 9 bases before, 20 behind


def test_matrix_market_of_many_parts(spark, tmp_path):
    rows = [(f"b{i % 37:02d}", f"g{i % 23:02d}", float(i % 5) + (0.5 if i % 7 == 0 else 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "barcode string, vcrs_id string, count double").dropDuplicates(["barcode", "vcrs_id"]).repartition(7)
    W.write_matrix_market(df, str(tmp_path / "m"))
    back = R.read_matrix_market(spark, *(str(tmp_path / "m" / n) for n in ("matrix.mtx", "barcodes.txt", "genes.txt")))
    assert back.exceptAll(df.filter("count <> 0").select("barcode", "vcrs_id", "count")).count() == 0 and back.count() == df.filter("count <> 0").count()
    with pytest.raises(Exception, match="exists"):
        W.write_matrix_market(df.filter(F.lit(True)), str(tmp_path / "m"))
