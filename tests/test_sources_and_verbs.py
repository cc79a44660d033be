"""Readers, writers, verbs and the command line on small files."""

import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.operators import assigned as A
from strandloom.operators import build as B
from strandloom.plans import technology as T
from strandloom.plans import verbs as V
from strandloom.sources import readers as R
from strandloom.sources import writers as W
from strandloom.streaming import assign_stream, count_molecules


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_readers(spark, tmp_path):
    fasta = put(tmp_path, "a.fa", ">s1.2 about c.1A>G\nACGT\nAC\n>s2\nGGGG\n")
    assert [tuple(r) for r in R.read_fasta(spark, fasta).select("seq_id", "sequence").collect()] == [("s1", "ACGTAC"), ("s2", "GGGG")]
    fastq = put(tmp_path, "a.fastq", "".join(f"@r{i}\n{'ACGT' * (i + 1)}\n+\n{'IIII' * (i + 1)}\n" for i in range(9)))
    assert [(r["read_index"], r["header"], len(r["sequence"])) for r in R.read_fastq(spark, fastq).orderBy("read_index").collect()] == [(i, f"r{i}", 4 * i + 4) for i in range(9)]
    vcf = put(tmp_path, "a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n19\t3\tv\tG\tGA,T\t.\tPASS\tAO=3;NS=2\n19\t4\tw\tT\t.\t.\t.\t.\n19\t4\tx\tC\tCGC\t.\t.\t.\n")
    rows = R.read_vcf(spark, vcf)
    assert rows.filter("ID = 'v'").select(F.col("INFO")["AO"]).first()[0] == "3"
    seqs = spark.createDataFrame([("19", "GCGCT")], "seq_id string, sequence string")
    got = {(r["ALT"], r["variant"], r["variant_type"]) for r in R.vcf_variants(rows, seqs).collect()}
    assert got == {("GA", "g.3_4insA", "insertion"), ("T", "g.3G>T", "substitution"), ("CGC", "g.3_4dup", "duplication")}
    gtf = put(tmp_path, "a.gtf", '#!x\n1\te\ttranscript\t1\t90\t.\t+\t.\tgene_id "G1"; transcript_id "T1.2"; gene_name "N";\n1\te\texon\t5\t9\t.\t+\t.\tgene_id "G1"; transcript_id "T1.2";\n')
    table = R.read_gtf(spark, gtf)
    assert [tuple(r) for r in R.transcript_genes(table, True).collect()] == [("T1", "G1")] and R.splice_junctions(table).count() == 2
    t2g = put(tmp_path, "t2g.txt", "a\tg1\nb\tg2\na\tg3\n")
    assert {tuple(r) for r in R.read_t2g(spark, t2g).collect()} == {("a", "g3"), ("b", "g2"), ("dlist", "dlist")}
    mtx = put(tmp_path, "m.mtx", "%%MatrixMarket\n2 3 2\n1 3 5\n2 1 1.5\n")
    cells = R.read_matrix_market(spark, mtx, put(tmp_path, "b.txt", "x\ny\n"), put(tmp_path, "g.txt", "v1\nv2\nv3\n"))
    assert {tuple(r) for r in cells.collect()} == {("x", "v3", 5.0), ("y", "v1", 1.5)}
    ec = R.read_equivalence_classes(spark, put(tmp_path, "matrix.ec", "0 0\n1 0,2\n"), put(tmp_path, "t.txt", "a\nb\n"))
    assert {(r["ec"], tuple(r["targets"])) for r in ec.collect()} == {(0, ("a",)), (1, ("a", "dlist"))}
    sam = put(tmp_path, "a.sam", "@x\nv_1_5\t0\t19\t7\t60\t5=\n")
    assert [tuple(r) for r in R.read_sam(spark, sam, 5).select("id", "pos", "end").collect()] == [("v_1", 7, 11)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("v1", "a:c.1A>C", "ACGT")], "vcrs_id string, vcrs_header string, vcrs_sequence string")
    W.write_fasta(df, str(tmp_path / "x.fa"), single=True)
    assert [tuple(r) for r in R.read_fasta(spark, str(tmp_path / "x.fa")).select("seq_id", "sequence").collect()] == [("v1", "ACGT")]
    W.write_id_map(df, str(tmp_path / "m.csv"))
    names = R.read_id_map(spark, str(tmp_path / "m.csv"))
    swapped = W.swap_names(spark.createDataFrame([("v1", "ACGT")], "seq_id string, sequence string"), names)
    assert swapped.first()["seq_id"] == "a:c.1A>C"
    records = spark.createDataFrame([("1", 5, "v", "A", "C", 3.0, 2)], "CHROM string, POS long, ID string, REF string, ALT string, AO double, NS long")
    W.write_vcf(records, str(tmp_path / "o.vcf"))
    back = R.read_vcf(spark, str(tmp_path / "o.vcf")).first()
    assert (back["CHROM"], back["POS"], back["INFO"]) == ("1", 5, {"AO": "3", "NS": "2"})
    W.write_config({"a": 1, "cosmic_password": "x"}, str(tmp_path / "c.json"))
    assert '"x"' not in (tmp_path / "c.json").read_text()


def test_technologies():
    assert T.strand_bias("dropseq") == "3p" and T.strand_bias("bulk") is None and T.strand_bias("10xv3", "5p") == "5p"
    for bad in (lambda: T.known("x"), lambda: T.strand_bias("10xv3"), lambda: T.strand_bias("dropseq", "5p")):
        with pytest.raises(ValueError, match="."):
            bad()
    names = ["b_S2_L001_R2_001.fastq", "b_S2_L001_R1_001.fastq", "a_S1_L001_I1_001.fastq", "a_S1_L001_R1_001.fastq"]
    assert V.sort_fastqs(names, "10xv3") == [names[3], names[1], names[0]]
    assert V.sort_fastqs(["x_2.fastq", "x_1.fastq"]) == ["x_1.fastq", "x_2.fastq"]


def test_reference_info_and_counts(spark):
    seq = "ACGTTGCAACCTGGATCGATTACGGCATTCAGGCTAAGCTTCCGATAAGCTGATCCGTAA"
    seqs = spark.createDataFrame([("s", seq)], "seq_id string, sequence string")
    variants = spark.createDataFrame([("s", f"c.{p}{seq[p - 1]}>{'ACGT'[('ACGT'.index(seq[p - 1]) + 1) % 4]}") for p in (15, 30, 45)], "seq_ID string, mutation string")
    kept, index = V.reference(variants, seqs, k=11, w=10)
    assert kept.count() == 3
    table = V.info(kept, "all", k=11, reference=seqs)
    row = table.orderBy("vcrs_id").first()
    assert row["alignment_to_reference"] is False and row["pseudoaligned_to_reference"] is False and row["vcrs_variant_type"] == "substitution" and row["kmer_overlap_with_other_VCRSs"] is False
    with pytest.raises(ValueError, match="unknown"):
        V.info(kept, ["nonsense"])
    reads = V.simulate(kept.select("vcrs_id", F.col("vcrs_sequence").alias("sequence")), read_length=15)
    assigned, matrix = V.count(reads.select(F.col("read_id").alias("read_index"), "sequence", F.lit("x").alias("sample")), index, 11)
    assert assigned.filter(F.col("targets")[0] != F.substring("read_index", 1, 6)).count() == 0
    cleaned, totals = V.clean(matrix, min_counts=2, use_binary=True)
    assert {r["vcrs_count"] for r in totals.collect()} == {1.0} and cleaned.count() == 3
    assert {k: v.count() for k, v in V.summarize(matrix, 2).items()} == {"detected": 1, "per_sample": 1, "top_by_count": 2, "top_by_samples": 2}
    purity = V.simulated_variants(kept, reads)
    assert {r["tumor_purity"] for r in purity.collect()} == {1.0}


def test_inputs_given_in_place_and_lists_of_files(spark, tmp_path):
    rows, seqs = B.literal_inputs(spark, ["ACGT", "GGGG"], "c.1A>C")
    assert [tuple(r) for r in rows.collect()] == [("seq1", "c.1A>C", "var1"), ("seq2", "c.1A>C", "var2")] and seqs.count() == 2
    with pytest.raises(ValueError, match="3 sequences"):
        B.literal_inputs(spark, ["A", "C", "G"], ["c.1A>C", "c.1C>A"])
    read = "@r\nACGT\n+\nIIII\n"
    one, two = put(tmp_path, "a.fastq", read), put(tmp_path, "b.fq", read * 2)
    put(tmp_path, "notes.md", "x")
    listed = put(tmp_path, "list.txt", f"{two}\n\n{one}\n")
    names = lambda source: [p.rsplit("/", 1)[-1] for p in R.list_fastqs(spark, source)]
    assert names(str(tmp_path)) == ["a.fastq", "b.fq"] and names(listed) == ["b.fq", "a.fastq"] and names(one) == ["a.fastq"] and names([two]) == ["b.fq"]
    together = R.concatenated([R.read_fastq(spark, p) for p in (one, two)])
    assert sorted((r["file_index"], r["read_index"]) for r in together.collect()) == [(0, 0), (1, 0), (1, 1)]


def test_reads_that_distractors_took(spark):
    targets = spark.createDataFrame([("v1", "ACGTACGGTTACG"), ("v2", "TTGCCCATGACCA")], "vcrs_id string, sequence string")
    dlist = spark.createDataFrame([("v1", "GGACGTACGGTT"), ("v2", "AAAAAAAAAAAA")], "id string, sequence string")
    reads = spark.createDataFrame([(1, ["v1"]), (2, ["v2"]), (3, ["v1", "v2"])], "read_index int, targets array<string>")
    assert [r["read_index"] for r in A.not_distracted(reads, targets, dlist, 7).collect()] == [2]


def test_all_columns(spark):
    seq = "ACGTTGCAACCTGGATCGATTACGGCATTCAGGCTAAGCTTCCGATAAGCTGATCCGTAA"
    vcrs = spark.createDataFrame([("v1", "s:c.15A>C;s:c.30G>A", seq[5:25]), ("v2", "s:c.40A>T", "TTTTTTTTTTTTTTT"), ("v3", "t:c.9A>C", seq[10:20])], "vcrs_id string, vcrs_header string, vcrs_sequence string")
    places = spark.createDataFrame([("s:c.15A>C", "s", 15, 15), ("s:c.30G>A", "s", 30, 30), ("s:c.40A>T", "s", 40, 40), ("t:c.9A>C", "t", 9, 9)], "header string, seq_id string, start int, end int")
    genes = spark.createDataFrame([("s:c.15A>C", "g1"), ("s:c.30G>A", "g1"), ("s:c.40A>T", "g1"), ("t:c.9A>C", None)], "header string, gene_name string")
    marks = spark.createDataFrame([("s", 33)], "seq_id string, position int")
    ref = spark.createDataFrame([("r", seq)], "seq_id string, sequence string")
    cdna = spark.createDataFrame([("s:c.15A>C", "AA"), ("s:c.30G>A", "CC"), ("s:c.40A>T", "GG")], "header string, vcrs_sequence string")
    genome = cdna.withColumn("vcrs_sequence", F.regexp_replace("vcrs_sequence", "GG", "GT"))
    table = V.info(vcrs, "all", k=9, near=5, reference=ref, transcriptome=ref.limit(0), junctions=marks, variants=places, genes=genes, cdna_vcrs=cdna, genome_vcrs=genome)
    got = {r["vcrs_id"]: r for r in table.collect()}
    one, two, three = (got[f"v{i}"] for i in (1, 2, 3))
    assert (one["alignment_to_reference"], one["alignment_to_reference_count_genome"], one["alignment_to_reference_cdna"], two["alignment_to_reference"]) == (True, 12, False, False)
    assert (one["substring_alignment_to_reference"], two["substring_alignment_to_reference_count_total"], three["substring_alignment_to_reference_genome"]) == (True, 0, True)
    assert one["pseudoaligned_to_reference"] and not one["pseudoaligned_to_reference_despite_not_truly_aligning"] and not two["pseudoaligned_to_reference"]
    assert (one["nearby_variants"], one["has_a_nearby_variant"], three["nearby_variants_count"]) == ([], False, 0)
    assert (one["distance_to_nearest_splice_junction"], one["is_near_splice_junction_5"], two["is_near_splice_junction_5"], three["distance_to_nearest_splice_junction"]) == (3, True, False, None)
    assert one["header_with_gene_name"] == "s(g1):c.15A>C;s(g1):c.30G>A" and three["header_with_gene_name"] == "t:c.9A>C"
    assert (one["number_of_variants_in_this_gene_total"], three["number_of_variants_in_this_gene_total"]) == (3, None)
    assert (one["cdna_and_genome_same"], two["cdna_and_genome_same"], three["cdna_and_genome_same"]) == (True, False, None)
    assert one["VCRSs_for_which_this_VCRS_is_a_superstring"] == ["v3"] and three["VCRS_is_a_substring_of_another_VCRS"]
    assert V.info(vcrs, ["has_a_nearby_variant"], k=12, variants=places).filter("has_a_nearby_variant").count() == 2
    with pytest.raises(ValueError, match="missing"):
        V.info(vcrs, ["header_with_gene_name"])


def test_single_cell_counts(spark):
    target = "ACGTACGGTTACGATTGCA"
    index = spark.createDataFrame([("v1", target)], "id string, sequence string")
    from strandloom.operators.kmers import kmer_index

    index = kmer_index(index, 11)
    rows = [(1, target, "AAAACCCC" + "T" * 22 + "GGGGTTTT" + "ACGTAC"), (2, target, "AAAACCCG" + "T" * 22 + "GGGGTTTT" + "ACGTAC"), (3, target, "CCCCCCCC" + "T" * 22 + "GGGGTTTT" + "GCGTAC")]
    reads = spark.createDataFrame(rows, "read_index int, read_0 string, read_1 string").withColumn("sequence", F.col("read_0"))
    with pytest.raises(ValueError, match="umi"):
        V.count(reads, index, 11, "INDROPSV2")
    _, matrix = V.count(reads, index, 11, "INDROPSV2", umi=(1, 38, 44))
    cell = lambda b: b + "TTT" + "GGGGTTTT"
    assert {(r["barcode"], r["count"]) for r in matrix.collect()} == {(cell(b), 1.0) for b in ("AAAACCCC", "AAAACCCG", "CCCCCCCC")}
    listed = spark.createDataFrame([(cell("AAAACCCC"),)], "barcode string")
    _, matrix = V.count(reads, index, 11, "INDROPSV2", umi=(1, 38, 44), whitelist=listed)
    assert [tuple(r) for r in matrix.collect()] == [(cell("AAAACCCC"), "v1", 1.0)]


def test_recount_and_totals(spark):
    vcrs = spark.createDataFrame([("v1", "T1:c.5A>C;T2:c.9A>C"), ("v2", "T3.1:c.700A>C")], "vcrs_id string, vcrs_header string")
    t2g = spark.createDataFrame([("T1.4", "G1.2"), ("T3", "G3")], "name string, label string")
    assert {r["vcrs_id"]: r["genes"] for r in V.variant_genes(vcrs, t2g=t2g).collect()} == {"v1": ["G1", "T2"], "v2": ["G3"]}
    assigned = spark.createDataFrame([("x", i, ["v1", "v2"]) for i in range(4)], "barcode string, read_index int, targets array<string>")
    mates = [("x", 0, ["G1"]), ("x", 0, []), ("x", 1, ["G3"]), ("x", 1, ["G1"]), ("x", 2, ["G9"]), ("x", 2, ["G9"])]
    genome = spark.createDataFrame(mates, "barcode string, read_index int, genes array<string>")
    got = lambda **o: {r["vcrs_id"]: r["count"] for r in V.recount(assigned, vcrs, genome, t2g=t2g, mates_apart=True, **o).collect()}
    assert got() == {"v1": 1.0} and got(multimapping=True) == {"v1": 3.0, "v2": 2.0} and got(multimapping=True, drop_different=True) == {"v1": 2.0, "v2": 1.0}
    matrix = spark.createDataFrame([("x", "v1", 3.0), ("x", "v2", 2.0)], "barcode string, vcrs_id string, count double")
    lengths = spark.createDataFrame([("T1", 10, 2000), ("T2", 10, 2000), ("T3", 10, 1000)], "transcript_id string, utr5 int, transcript_length int")
    assert {r["vcrs_id"] for r in V.within_reach(matrix, vcrs, lengths, "dropseq", 200).collect()} == {"v2"}
    assert V.within_reach(matrix, vcrs, lengths, "bulk", 200).count() == 2
    more = spark.createDataFrame([("v1", "note"), ("v1", "note")], "vcrs_id string, comment string")
    totals = V.described_totals(V.clean(matrix)[1], vcrs, t2g=t2g, metadata=more)
    assert {(r["vcrs_id"], r["vcrs_count"], tuple(r["genes"]), r["comment"]) for r in totals.collect()} == {("v1", 3.0, ("G1", "T2"), "note"), ("v2", 2.0, ("G3",), None)}


def test_command_line(spark, tmp_path):
    fasta = put(tmp_path, "s.fa", ">s x\nCCCCGCCCCACCCCGCCCCTCCCCGCCCCACCCCGCCCCTCCCCGCCCCACCCCGCCCCTCCCCGCCCCACCCCG\n")
    table = put(tmp_path, "v.csv", "seq_ID,mutation\ns,c.35G>A\ns,c.20+3T>A\n")
    out = str(tmp_path / "out")
    cli.main(["build", "--variants", table, "--sequences", fasta, "--out", out, "-w", "30", "-k", "31"], spark)
    assert [r["vcrs_sequence"] for r in spark.read.parquet(f"{out}/vcrs.parquet").collect()] == ["GCCCCACCCCGCCCCTCCCCGCCCCACCCCACCCCTCCCCGCCCCACCCCGCCCCTCCCCG"]
    assert {(r["drop_reason"], r["variants"]) for r in spark.read.parquet(f"{out}/report.parquet").collect()} == {(None, 1), ("intronic", 1)}
    cli.main(["info", "--vcrs", f"{out}/vcrs.parquet", "--variants", f"{out}/variants.parquet", "--genome", fasta, "-k", "31", "--out", out], spark)
    assert spark.read.parquet(f"{out}/info.parquet").first()["nearby_variants_count"] == 0
    cli.main(["sim", "--vcrs", f"{out}/vcrs.parquet", "--out", out, "--read-length", "40"], spark)
    cli.main(["count", "--fastq", f"{out}/reads.fastq", "--vcrs", f"{out}/vcrs.parquet", "--out", out, "-k", "31"], spark)
    cli.main(["clean", "--counts", f"{out}/counts.parquet", "--out", f"{out}/clean"], spark)
    assert spark.read.parquet(f"{out}/clean/totals.parquet").first()["vcrs_count"] == 44
    cli.main(["fastqpp", "--fastq", f"{out}/reads.fastq", "--out", f"{out}/pp", "--trim-head", "2", "--min-length", "38"], spark)
    assert {len(r["sequence"]) for r in R.read_fastq(spark, f"{out}/pp/reads.fastq").collect()} == {38}
    cli.main(["clean", "--counts", f"{out}/counts.parquet", "--vcrs", f"{out}/vcrs.parquet", "--t2g", put(tmp_path, "t2g.tsv", "s\tg\n"), "--out", f"{out}/clean2"], spark)
    assert spark.read.parquet(f"{out}/clean2/totals.parquet").first()["genes"] == ["g"]


def test_streaming(spark, tmp_path):
    reads = spark.createDataFrame([(1, "2024-01-01 00:00:01", "c1", "u1", "ACGTACC"), (2, "2024-01-01 00:00:02", "c1", "u1", "ACGTACC"), (3, "2024-01-01 00:00:03", "c1", "u2", "GGTACGT")], "read_index long, t string, barcode string, umi string, sequence string")
    reads.withColumn("ts", F.col("t").cast("timestamp")).drop("t").write.parquet(str(tmp_path / "in"))
    index = spark.createDataFrame([("ACGTACC", "v1")], "kmer string, target string")
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    counted = count_molecules(assign_stream(stream, index, 7))
    q = counted.writeStream.outputMode("complete").format("memory").queryName("molecules").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["barcode"], r["target"], r["molecules"]) for r in spark.table("molecules").collect()] == [("c1", "v1", 2)]
