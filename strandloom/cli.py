"""``python -m strandloom.cli VERB ...``: reads tables, applies a verb, writes its results."""

from __future__ import annotations

import argparse
import functools

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import adapters as AD
from .operators import profile as PR
from .operators import ranges as R_
from .operators.build import with_transcript_bounds
from .plans import technology as T
from .plans import verbs as V
from .sources import readers as R
from .sources import writers as W


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("strandloom", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, about: str, *inputs: str) -> argparse.ArgumentParser:
        p = verbs.add_parser(name, help=about)
        for i in inputs:
            p.add_argument(f"--{i}", required=True)
        p.add_argument("--out", required=True, help="folder for the results")
        p.add_argument("--overwrite", action="store_true")
        return p

    for name, about in (("build", "variant-containing reference sequences"), ("ref", "build, describe and filter")):
        p = verb(name, about, "variants", "sequences")
        p.add_argument("-w", type=int, default=47)
        p.add_argument("-k", type=int, default=51)
        p.add_argument("--seq-id-column", default="seq_ID")
        p.add_argument("--var-column", default="mutation")
        p.add_argument("--var-id-column")
        p.add_argument("--max-ambiguous", type=int, default=0)
        p.add_argument("--min-seq-len", type=int)
        p.add_argument("--disable-optimize-flanks", action="store_true")
        p.add_argument("--disable-merge-identical", action="store_true")
        p.add_argument("--keep-wild-type-kmers", action="store_true")
        p.add_argument("--stranded", action="store_true")
        p.add_argument("--gtf", help="keep flanks within the transcripts of this GTF")
    p.add_argument("--filters", nargs="*", default=list(V.DEFAULT_FILTERS))
    p.add_argument("--genome")
    p = verb("info", "columns that describe sequences", "vcrs")
    p.add_argument("--columns", nargs="*", default=["all"])
    p.add_argument("-k", type=int, default=59)
    p.add_argument("--genome")
    p.add_argument("--transcriptome")
    p.add_argument("--gtf", help="for splice junctions")
    p.add_argument("--variants", help="the variants that build has written")
    p.add_argument("--gene-column", help="a column of --variants")
    p.add_argument("--near-splice-junction-threshold", type=int, default=10)
    p.add_argument("--stranded", action="store_true")
    p = verb("filter", "rows that pass filters", "table")
    p.add_argument("--filters", nargs="+", required=True)
    p = verb("fastqpp", "cleaner reads", "fastq")
    p.add_argument("--mask-below", type=int)
    p.add_argument("--split-n", action="store_true")
    p.add_argument("--min-length", type=int, default=0)
    p.add_argument("--max-n", type=int)
    p.add_argument("--mean-quality", type=int)
    p.add_argument("--trim-head", type=int, default=0)
    p.add_argument("--trim-tail", type=int, default=0)
    p.add_argument("--cut-window", type=int, help="cut where the mean quality of so many bases falls under --cut-mean")
    p.add_argument("--cut-mean", type=int, default=13)
    p.add_argument("--trim-poly-g", type=int, help="least length of a run of Gs at the end that is cut")
    p.add_argument("--mates", help="the second reads; pairs are cut to their insert and stay or go together")
    p.add_argument("--keep-inserts", action="store_true", help="don't look for inserts that are shorter than mates")
    p.add_argument("--adapter", help="cut at this sequence; auto: find it")
    p.add_argument("--adapter-mates", help="the same for the second reads")
    p.add_argument("--profile", action="store_true", help="qualities and bases by cycle, and sequences that come too often")
    p = verb("count", "counts of variants", "vcrs")
    p.add_argument("--fastq", required=True, nargs="+", help="bulk: one file for each sample; else the files of a read, in order")
    p.add_argument("-k", type=int, default=59)
    p.add_argument("--sample", nargs="*", help="names of the samples (bulk)")
    p.add_argument("--technology", default="bulk")
    p.add_argument("--umi", nargs=3, type=int, metavar=("FILE", "START", "END"))
    p.add_argument("--whitelist", help="barcodes, one a line")
    p.add_argument("--no-union", action="store_true", help="only targets that all k-mers of a read share")
    p.add_argument("--no-multimapping", action="store_true")
    p = verb("clean", "recount, thresholds and totals", "counts")
    p.add_argument("--assigned", help="reads of count, to be recounted by --genome-reads")
    p.add_argument("--genome-reads", help="the same reads with their genes: barcode, read_index, genes")
    p.add_argument("--mates-apart", action="store_true")
    p.add_argument("--drop-different-mates", action="store_true")
    p.add_argument("--mistake-ratio", type=float)
    p.add_argument("--multimapping", action="store_true")
    p.add_argument("--vcrs", help="sequences with vcrs_id and vcrs_header, for genes and headers")
    p.add_argument("--t2g")
    p.add_argument("--metadata", help="table with vcrs_id")
    p.add_argument("--gtf", help="with --technology and --read-length: only variants that reads can reach")
    p.add_argument("--technology", default="bulk")
    p.add_argument("--strand-bias-end", choices=["5p", "3p"])
    p.add_argument("--read-length", type=int)
    p.add_argument("--min-counts", type=float, default=2)
    p.add_argument("--binary", action="store_true")
    p.add_argument("--drop-empty", action="store_true")
    p.add_argument("--sum", action="store_true", help="all barcodes together")
    p.add_argument("--cpm", action="store_true")
    p.add_argument("--cell-min-counts", help="a number, or knee")
    p.add_argument("--cell-min-variants", type=int)
    p.add_argument("--variant-min-cells", type=int)
    p.add_argument("--mitochondrial", help="genes, one a line, with --max-mitochondrial")
    p.add_argument("--max-mitochondrial", type=float, help="largest share of a cell's counts")
    for n in ("keep", "exclude"):
        p.add_argument(f"--{n}", help="vcrs ids, one a line")
        p.add_argument(f"--{n}-genes", help="genes, one a line (needs --vcrs)")
    p.add_argument("--double-counts", choices=["pieces", "mates"], help="take off what pieces of a read, or mates, counted twice (needs --reads)")
    p.add_argument("--reads", help="barcode, fastq_header, ec, targets, counted_in_count_matrix")
    p.add_argument("--vcf", help="records with ID, CHROM, POS, REF and ALT: a VCF of the detected variants is written")
    p.add_argument("--matrix-market", action="store_true")
    p = verb("summarize", "summary tables", "counts")
    p.add_argument("--top", type=int, default=10)
    p = verb("sim", "synthetic reads", "vcrs")
    p.add_argument("--read-length", type=int, default=150)
    p.add_argument("--reads", default="all", help="of each variant: a number, or all")
    p.add_argument("--wild-type", help="a column of --vcrs with wild-type parents")
    p.add_argument("--wild-type-reads", default="all")
    p.add_argument("--sequence-column", default="vcrs_sequence")
    p.add_argument("--variants", type=int, help="how many variants; all without")
    p.add_argument("--filters", nargs="*", default=[], help="of the variants that may be chosen")
    p.add_argument("--without", help="table of vcrs_id that may not be chosen")
    p.add_argument("--noise", action="store_true", help="qualities with noise")
    p.add_argument("--error-rate", type=float, default=0.0)
    p.add_argument("--seed", type=int, default=42)
    return top


def _whitelist(spark: SparkSession, path: str | None):
    return spark.read.text(path).select(F.col("value").alias("barcode")) if path else None


def _reads(spark: SparkSession, a: argparse.Namespace):
    """The FASTQ files as reads: bulk files one after the other, files of a read side by side."""
    tables = [R.read_fastq(spark, path) for path in a.fastq]
    if T.BARCODES[T.known(a.technology)] is None:
        names = a.sample or [f"sample{i}" if i else "sample" for i in range(len(tables))]
        if len(names) != len(tables):
            raise SystemExit("as many names of samples as files are needed")
        # a read is known by its file and number
        numbered = [t.withColumns({"sample": F.lit(n), "read_index": F.col("read_index") * len(tables) + i}) for i, (t, n) in enumerate(zip(tables, names, strict=True))]
        out = numbered[0]
        for t in numbered[1:]:
            out = out.unionByName(t)
        return out
    sides = [t.select("read_index", F.col("sequence").alias(f"read_{i}")) for i, t in enumerate(tables)]
    out = sides[0]
    for t in sides[1:]:
        out = out.join(t, "read_index")
    return out.withColumn("sequence", F.col(f"read_{T.TRANSCRIPT_FILE[T.known(a.technology)]}"))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName(f"strandloom {a.verb}").getOrCreate()
    mode = "overwrite" if a.overwrite else "errorifexists"

    def save(df, name: str) -> None:
        df.write.mode(mode).parquet(f"{a.out}/{name}.parquet")

    def sequences(path: str):
        return R.read_fasta(spark, path).select("seq_id", "sequence")

    if a.verb in ("build", "ref"):
        options = {
            "w": a.w, "k": a.k, "max_ambiguous": a.max_ambiguous, "min_seq_len": a.min_seq_len, "optimize_flanks": not a.disable_optimize_flanks,
            "merge_identical": not a.disable_merge_identical, "merge_reverse_complements": not a.stranded, "remove_wild_type_kmers": not a.keep_wild_type_kmers,
            "seq_id_column": a.seq_id_column, "var_column": a.var_column, "var_id_column": a.var_id_column,
        }
        seqs = sequences(a.sequences)
        if ".vcf" in a.variants:
            rows = R.vcf_variants(R.without_chr(R.read_vcf(spark, a.variants), seqs), seqs)
            options |= {"seq_id_column": "CHROM", "var_column": "variant", "var_id_column": None}
            rows = rows.drop("variant_type", "INFO", "samples")
        else:
            rows = R.read_table(spark, a.variants)
        if a.gtf:
            rows = with_transcript_bounds(rows, R.read_gtf(spark, a.gtf), options["seq_id_column"])
            options["transcript_bounds"] = True
        if a.verb == "build":
            built = V.build(rows, seqs, **options)
            vcrs = built.vcrs
            save(built.report(), "report")
            W.write_removed(built.checked, f"{a.out}/removed.txt", mode=mode)
            save(built.variants, "variants")
        else:
            genome = sequences(a.genome) if a.genome else None
            vcrs, index = V.reference(rows, seqs, a.filters, genome=genome, stranded=a.stranded, **options)
            save(index, "index")
        save(vcrs, "vcrs")
        W.write_fasta(vcrs, f"{a.out}/vcrs.fa", mode=mode)
        W.write_t2g(vcrs, f"{a.out}/t2g.tsv", mode=mode)
        W.write_id_map(vcrs, f"{a.out}/id_to_header.csv", mode=mode)
    elif a.verb == "info":
        inputs = {"k": a.k, "stranded": a.stranded, "near": a.near_splice_junction_threshold}
        inputs |= {name: sequences(path) for name, path in (("reference", a.genome), ("transcriptome", a.transcriptome)) if path}
        if a.gtf:
            inputs["junctions"] = R.splice_junctions(R.read_gtf(spark, a.gtf))
        if a.variants:
            rows = spark.read.parquet(a.variants)
            inputs["variants"] = rows.select("header", "seq_id", "start", "end")
            if a.gene_column:
                inputs["genes"] = rows.select("header", F.col(a.gene_column).alias("gene_name"))
        save(V.info(spark.read.parquet(a.vcrs), a.columns, **inputs), "info")
    elif a.verb == "filter":
        save(V.filter(R.read_table(spark, a.table), a.filters), "filtered")
    elif a.verb == "fastqpp":
        reads = R.read_fastq(spark, a.fastq)
        control = {"min_length": a.min_length, "max_n": a.max_n, "mean_quality": a.mean_quality}
        trim = {"head": a.trim_head, "tail": a.trim_tail, "window": a.cut_window, "mean": a.cut_mean, "poly_g": a.trim_poly_g}
        if a.profile:
            save(PR.quality_profile(reads), "profile")
            save(PR.overrepresented(reads), "overrepresented")
        found = lambda given, t: AD.infer_adapter(t) if given == "auto" else given
        if a.mates:
            mates = R.read_fastq(spark, a.mates)
            adapters = (found(a.adapter, reads), found(a.adapter_mates, mates))
            sides = V.clean_pairs(reads, mates, cut_inserts=not a.keep_inserts, adapters=adapters, trim=trim, control=control)
            for i, side in enumerate(sides, 1):
                W.write_fastq(side.orderBy("read_index"), f"{a.out}/reads_{i}.fastq", mode=mode)
            return
        if a.adapter:
            reads = AD.without_adapter(reads, found(a.adapter, reads))
        W.write_fastq(V.clean_reads(reads, trim=trim, control=control, mask_below=a.mask_below, split_n=a.split_n, min_length=a.min_length or None), f"{a.out}/reads.fastq", mode=mode)
    elif a.verb == "count":
        options = {"multimapping": not a.no_multimapping, "union": not a.no_union, "umi": tuple(a.umi) if a.umi else None}
        assigned, matrix = V.count(_reads(spark, a), spark.read.parquet(a.vcrs), a.k, a.technology, whitelist=_whitelist(spark, a.whitelist), **options)
        save(assigned, "assigned")
        save(matrix, "counts")
    elif a.verb == "clean":
        vcrs = spark.read.parquet(a.vcrs) if a.vcrs else None
        t2g = R.read_t2g(spark, a.t2g).toDF("name", "label") if a.t2g else None
        matrix = spark.read.parquet(a.counts)
        if a.genome_reads:
            options = {"mates_apart": a.mates_apart, "drop_different": a.drop_different_mates, "multimapping": a.multimapping, "mistake_ratio": a.mistake_ratio}
            matrix = V.recount(spark.read.parquet(a.assigned), vcrs, spark.read.parquet(a.genome_reads), t2g=t2g, **options)
        if a.gtf and a.read_length:
            lengths = R_.transcript_lengths(R.read_gtf(spark, a.gtf))
            matrix = V.within_reach(matrix, vcrs, lengths, a.technology, a.read_length, a.strand_bias_end)
            vcrs = V.reachable(vcrs, lengths, a.technology, a.read_length, a.strand_bias_end)
        ids = lambda path: R.read_list(spark, path, "vcrs_id") if path else None
        of_genes = lambda path: V.of_genes(vcrs, R.read_list(spark, path, "gene_id"), t2g=t2g) if path else None
        either = lambda *sets: functools.reduce(lambda x, y: x.unionByName(y), [s for s in sets if s is not None]) if any(s is not None for s in sets) else None
        least = a.cell_min_counts if a.cell_min_counts in (None, "knee") else float(a.cell_min_counts)
        quality = {"min_counts": least, "min_variants": a.cell_min_variants, "min_cells": a.variant_min_cells}
        quality |= {"mitochondrial": of_genes(a.mitochondrial), "max_mitochondrial": a.max_mitochondrial}
        matrix, totals = V.clean(
            matrix, min_counts=a.min_counts, use_binary=a.binary, drop_empty=a.drop_empty, sum_rows=a.sum, cpm=a.cpm, quality=quality,
            keep=either(ids(a.keep), of_genes(a.keep_genes)), exclude=either(ids(a.exclude), of_genes(a.exclude_genes)),
            reads=spark.read.parquet(a.reads) if a.reads else None, split_at_n=a.double_counts == "pieces", mates=a.double_counts == "mates",
        )
        if vcrs is not None:
            totals = V.described_totals(totals, vcrs, t2g=t2g, metadata=R.read_table(spark, a.metadata) if a.metadata else None)
        save(matrix, "counts")
        save(totals, "totals")
        if a.vcf:
            records = R.read_vcf(spark, a.vcf) if ".vcf" in a.vcf else R.read_table(spark, a.vcf)
            W.write_vcf(V.vcf(totals, records.select("ID", "CHROM", F.col("POS").cast("long").alias("POS"), "REF", "ALT")), f"{a.out}/variants.vcf", mode=mode)
        if a.matrix_market:
            W.write_matrix_market(matrix, f"{a.out}/matrix_market", mode=mode)
    elif a.verb == "summarize":
        for name, table in V.summarize(spark.read.parquet(a.counts), a.top, ranks=True).items():
            save(table, name)
    elif a.verb == "sim":
        table = spark.read.parquet(a.vcrs)
        table = table if "vcrs_id" in table.columns else table.withColumnRenamed("header", "vcrs_id")
        chosen = V.chosen_variants(table, a.variants, filters=a.filters, without=spark.read.parquet(a.without) if a.without else None, seed=a.seed)
        parents = lambda c: chosen.select("vcrs_id", F.col(c).alias("sequence"))
        number = lambda n: "all" if n == "all" else int(n)
        wild = parents(a.wild_type) if a.wild_type else None
        reads = V.simulate(
            parents(a.sequence_column), wild, read_length=a.read_length, alt=number(a.reads), ref=number(a.wild_type_reads), error_rate=a.error_rate, noise=a.noise, seed=a.seed
        )
        save(reads, "reads")
        save(V.simulated_variants(chosen, reads), "simulated")
        W.write_fastq(reads.withColumnRenamed("read_id", "header"), f"{a.out}/reads.fastq", mode=mode)


if __name__ == "__main__":
    main()
