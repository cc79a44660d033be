"""The verbs: DataFrames in, DataFrames out.  Reading and writing is the caller's (see ``cli``)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..operators import adapters as AD
from ..operators import assigned as A
from ..operators import counts as C
from ..operators import filters as FL
from ..operators import info as I
from ..operators import kmers as K
from ..operators import ranges as R
from ..operators import reads as RD
from ..operators import simulate as SIM
from ..operators.build import Built, BuildOptions
from ..operators.build import build as _build
from ..operators.fixed import materialised
from ..operators.sample import exact_sample
from . import technology as T
from .describe import info

#: Filters of ``reference`` where none are given.
DEFAULT_FILTERS = (
    "alignment_to_reference:is_not_true", "pseudoaligned_to_reference:is_not_true", "num_distinct_triplets:greater_than=5",
    "longest_homopolymer_length:less_or_equal=10",
)


def build(variants: DataFrame, sequences: DataFrame, *, seq_id_column="seq_ID", var_column="mutation", var_id_column=None, **options) -> Built:
    return _build(variants, sequences, BuildOptions(**options), seq_id_col=seq_id_column, var_col=var_column, id_col=var_id_column)


def filter(table: DataFrame, filters) -> DataFrame:  # noqa: A001
    return FL.apply_filters(table, filters)


def reference(variants: DataFrame, sequences: DataFrame, filters=DEFAULT_FILTERS, *, k: int = 51, w: int = 47, genome: DataFrame | None = None, stranded: bool = False, **options):
    """(vcrs that pass, k-mer index): only the columns that the filters name are worked out."""
    parsed = FL.parse_filters(filters)
    built = build(variants, sequences, k=k, w=w, **options)
    needs_genome = {"alignment_to_reference", "pseudoaligned_to_reference"}
    vcrs = materialised(built.vcrs)
    columns = [f.column for f in parsed if f.column not in vcrs.columns and (genome is not None or f.column not in needs_genome)]
    described = info(vcrs, list(dict.fromkeys(columns)), k=k, reference=genome, stranded=stranded)
    kept = materialised(filter(described, parsed).select(*vcrs.columns))
    return kept, K.kmer_index(kept, k, stranded, "vcrs_id", "vcrs_sequence")


def clean_reads(
    reads: DataFrame, *, trim: dict | None = None, control: dict | None = None, mask_below: int | None = None, split_n: bool = False, min_length: int | None = None, mates: DataFrame | None = None,
) -> DataFrame:
    """Trimming, quality control, masking and splitting at Ns, in this order; all are off by default."""
    out = RD.trim(reads, **trim) if trim else reads
    out = RD.quality_control(out, **control) if control else out
    out = RD.agreeing(out, mates) if mates is not None else out
    out = RD.mask(out, mask_below) if mask_below is not None else out
    return RD.split_at_n(out, min_length) if split_n else out


def clean_pairs(
    one: DataFrame, two: DataFrame, *, cut_inserts: bool = True, adapters: tuple[str | None, str | None] = (None, None), trim: dict | None = None, control: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Mates (read_index, header, sequence, quality): what lies behind their insert is cut where they overlap, adapters that are
    given are cut as well, and both are trimmed; a pair stays if both mates pass the controls.

    Splitting at Ns is left out, since pieces have no mates.
    """
    side = lambda df, i: df.select("read_index", *(F.col(c).alias(f"{c}_{i}") for c in ("header", "sequence", "quality")))
    pairs = side(one, 1).join(side(two, 2), "read_index")
    pairs = AD.trimmed_to_insert(pairs) if cut_inserts else pairs
    out = []
    for i, adapter in enumerate(adapters, 1):
        reads = pairs.select("read_index", *(F.col(f"{c}_{i}").alias(c) for c in ("header", "sequence", "quality")))
        reads = AD.without_adapter(reads, adapter) if adapter else reads
        out.append(clean_reads(reads, trim=trim, control=control))
    return RD.agreeing(out[0], out[1]), RD.agreeing(out[1], out[0])


def count(
    reads: DataFrame, index: DataFrame, k: int, technology: str = "bulk", *, multimapping: bool = True, union: bool = True, stranded: bool = False,
    umi: tuple[int, int, int] | None = None, whitelist: DataFrame | None = None,
):
    """(assigned reads, counts).  ``index``: sequences (vcrs_id, vcrs_sequence), or single k-mers (kmer,
    target), which cost more to join.  ``reads``: read_index, sequence, and sample for bulk; else read_0,
    read_1 ... (a read's files) or barcode_read (the one file that holds barcode and UMI).  Mates
    share a read_index.

    ``umi`` is (file, start, end) of the UMI; it must be given where a technology's isn't known.
    A read's targets are those that any of its k-mers has, or without ``union`` those that all have.
    With ``whitelist`` (barcode) only listed barcodes count, and those one change away.
    """
    name = T.known(technology)
    spans = T.BARCODES[name]
    if "kmer" in index.columns:
        targets = K.pseudoalign(reads, index, k, stranded=stranded, union=union)
    else:
        targets = K.pseudoalign_to(reads, index, k, stranded=stranded, union=union, id_col="vcrs_id", seq_col="vcrs_sequence")
    if spans is None:
        cells = reads.select("read_index", F.col("sample").alias("barcode")).distinct()
        assigned = targets.join(cells, "read_index")
        return assigned, C.count_matrix(assigned, umis=False, multimapping=multimapping)
    if umi is None and name not in T.UMIS:
        raise ValueError(f"where a UMI lies in {technology} reads isn't known here: give umi=(file, start, end)")
    umi = umi or T.UMIS[name]
    files = lambda f: "barcode_read" if "barcode_read" in reads.columns else f"read_{f}"
    cells = reads.select("read_index", Q.barcode_of_files(files, spans).alias("barcode"), Q.barcode_of_files(files, [umi]).alias("umi")).distinct()
    cells = C.rescue_barcodes(cells, whitelist) if whitelist is not None else cells
    assigned = targets.join(cells, "read_index")
    return assigned, C.count_matrix(assigned, umis=True, multimapping=multimapping)


def variant_genes(vcrs: DataFrame, *, t2g: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """Per vcrs_id its genes, from its headers: ``t2g`` (name, label) for transcripts, ``genes``
    (seq_id, start, end, gene_id, ordinal) for places on a genome."""
    each = A.header_information(I.explode_headers(vcrs.select("vcrs_id", "vcrs_header")), t2g=t2g, genes=genes)
    return each.groupBy("vcrs_id").agg(F.array_sort(F.collect_set("gene_id")).alias("genes"))


def recount(
    assigned: DataFrame, vcrs: DataFrame, genome: DataFrame, *, t2g: DataFrame | None = None, genes: DataFrame | None = None, mates_apart: bool = False,
    drop_different: bool = False, multimapping: bool = False, count_unaligned: bool = True, mistake_ratio: float | None = None,
) -> DataFrame:
    """Counts of ``assigned`` (barcode, read_index, targets) that agree with the same reads' genes on
    a genome (``genome``: barcode, read_index, genes).

    With ``mates_apart`` both reads of a pair are in ``genome`` under one read_index, and each has
    the genes of either; ``drop_different`` leaves out pairs that agree on none.
    """
    seen = genome.select(*A.READ, F.col("genes").alias("genome_genes"))
    if mates_apart:
        seen = A.paired_genes(seen, drop_different=drop_different).distinct()
        if drop_different:
            dropped = genome.select(*A.READ).distinct().join(seen.select(*A.READ), A.READ, "left_anti")
            assigned = assigned.join(dropped, A.READ, "left_anti")
    own = variant_genes(vcrs, t2g=t2g, genes=genes)
    seen = seen.withColumnRenamed("genome_genes", "genes").filter(F.size("genes") > 0)
    return C.recount_by_genome(assigned, seen, own, multimapping=multimapping, count_unaligned=count_unaligned, mistake_ratio=mistake_ratio)


def reachable(vcrs: DataFrame, lengths: DataFrame, technology: str, read_length: int, end: str | None = None) -> DataFrame:
    """``vcrs`` with the headers of those variants only that the technology's reads can reach; one without any goes.

    A vcrs_id is one row's; columns besides it and the header are joined to what stays.
    """
    side = T.strand_bias(technology, end)
    if side is None:
        return vcrs
    each = A.header_information(I.explode_headers(vcrs.select("vcrs_id", "vcrs_header")))
    each = each.select("vcrs_id", "vcrs_header_individual", F.col("seq_ID").alias("transcript_id"), F.col("start_variant_position").alias("start"), F.col("end_variant_position").alias("end"))
    within = R.within_strand_reach(each, lengths, end=side, read_length=read_length)
    headers = within.groupBy("vcrs_id").agg(F.array_join(F.array_sort(F.collect_list("vcrs_header_individual")), ";").alias("vcrs_header"))
    more = vcrs.drop("vcrs_header")
    return (more.join(headers, "vcrs_id") if len(more.columns) > 1 else headers).select(*vcrs.columns)


def within_reach(matrix: DataFrame, vcrs: DataFrame, lengths: DataFrame, technology: str, read_length: int, end: str | None = None) -> DataFrame:
    """Counts of variants that the technology's reads can reach: one of a VCRS's variants is enough."""
    if T.strand_bias(technology, end) is None:
        return matrix
    return C.keep_variants(matrix, reachable(vcrs, lengths, technology, read_length, end))


def of_genes(vcrs: DataFrame, genes: DataFrame, *, t2g: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """vcrs_id of the sequences that have one of ``genes`` (gene_id) among theirs."""
    own = variant_genes(vcrs, t2g=t2g, genes=places).select("vcrs_id", F.explode("genes").alias("gene_id"))
    return own.join(genes.select("gene_id").distinct(), "gene_id", "left_semi").select("vcrs_id").distinct()


def vcf(totals: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of a VCF for the detected variants of ``totals`` (vcrs_header, vcrs_count, number_obs) at one place each."""
    return C.single_locus_records(totals, records)


def described_totals(totals: DataFrame, vcrs: DataFrame, *, t2g: DataFrame | None = None, genes: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """``totals`` of variants with their headers, genes, and ``metadata`` (vcrs_id and more)."""
    out = totals.join(vcrs.select("vcrs_id", "vcrs_header").dropDuplicates(["vcrs_id"]), "vcrs_id", "left")
    if t2g is not None or genes is not None:
        out = out.join(variant_genes(vcrs, t2g=t2g, genes=genes), "vcrs_id", "left")
    return A.with_metadata(out, metadata) if metadata is not None else out


def clean(
    matrix: DataFrame, *, min_counts: float = 2, use_binary: bool = False, drop_empty: bool = False, sum_rows: bool = False, cpm: bool = False,
    keep: DataFrame | None = None, exclude: DataFrame | None = None, quality: dict | None = None, reads: DataFrame | None = None, split_at_n: bool = False, mates: bool = False,
):
    """(counts, totals per variant).

    With ``reads`` (barcode, fastq_header, ec, targets, counted_in_count_matrix) what pieces of one read (``split_at_n``), or mates,
    have counted twice is taken off first.  ``quality`` are options of ``counts.quality_filter``.
    """
    out = A.without_double_counts(matrix, reads, split_at_n=split_at_n, mates=mates) if reads is not None and (split_at_n or mates) else matrix
    out = C.min_counts(out, min_counts) if min_counts else out
    out = C.sum_rows(out) if sum_rows else out
    out = C.binary(out) if use_binary else out
    out = C.quality_filter(out, **quality) if quality else out
    out = C.keep_variants(out, keep) if keep is not None else out
    out = C.keep_variants(out, exclude, keep=False) if exclude is not None else out
    out = C.drop_empty(out) if drop_empty else out
    out = C.per_million(out) if cpm else out
    return out, C.variant_totals(out)


def summarize(matrix: DataFrame, top: int = 10, genes: DataFrame | None = None, ranks: bool = False) -> dict[str, DataFrame]:
    """Tables: detected (how many variants at all), per_sample, top_by_count, top_by_samples, with ``ranks`` top_per_sample (the
    first of each sample, ranked), genes."""
    totals = C.variant_totals(matrix)
    out = {
        "detected": totals.agg(F.count_if("vcrs_detected").alias("detected"), F.count("*").alias("variants")),
        "per_sample": C.cell_totals(matrix),
        "top_by_count": C.top_variants(matrix, top),
        "top_by_samples": C.top_variants(matrix, top, "samples"),
    }
    if ranks:
        out["top_per_sample"] = C.variant_ranks(matrix, top)
    if genes is not None:
        out["genes"] = C.gene_counts(matrix, genes).orderBy(F.desc("gene_count"), "gene").limit(top)
    return out


def simulate(mutant: DataFrame, wild: DataFrame | None = None, *, read_length: int = 150, alt="all", ref="all", strand: str = "both", error_rate: float = 0.0, noise: bool = False, seed: int = 42) -> DataFrame:
    """Reads of mutant parents (vcrs_id, sequence) and of wild-type ones, all of them or a number each."""
    parts = []
    for parents, number, is_mutant in ((mutant, alt, True), (wild, ref, False)):
        if parents is None or not number:
            continue
        if number == "all":
            parts.append(SIM.every_read(parents, read_length, strand, is_mutant))
        else:
            parts.append(SIM.sampled_reads(parents, read_length, number, seed=seed, strand="random" if strand == "both" else strand, mutant=is_mutant))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = SIM.sequencing_errors(out, rate=error_rate, seed=seed) if error_rate else out
    return SIM.noisy_quality(out, seed=seed) if noise else out.withColumn("quality", F.repeat(F.lit("I"), F.length("sequence")))


def chosen_variants(variants: DataFrame, n: int | None = None, *, filters=(), without: DataFrame | None = None, key: str = "vcrs_id", seed: int = 42) -> DataFrame:
    """Exactly ``n`` (all without a number) of the variants that pass ``filters`` and aren't in ``without`` (``key``)."""
    out = FL.apply_filters(variants, list(filters)) if filters else variants
    out = out.join(without.select(key).distinct(), key, "left_anti") if without is not None else out
    return out if n is None else exact_sample(out, n, key, seed=seed)


def simulated_variants(variants: DataFrame, reads: DataFrame) -> DataFrame:
    """``variants`` (vcrs_id) with their numbers of reads, where these start, and tumor purity."""
    n = reads.groupBy("vcrs_id").agg(
        F.count_if(F.col("kind") == "M").alias("number_of_reads_mutant"), F.count_if(F.col("kind") == "W").alias("number_of_reads_wt"),
        *(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("start")))).alias(f"list_of_read_starting_indices_{name}") for kind, name in (("M", "mutant"), ("W", "wt"))),
    )
    out = variants.join(n, "vcrs_id", "left").fillna(0, ["number_of_reads_mutant", "number_of_reads_wt"])
    return SIM.tumor_purity(out)


def sort_fastqs(names: list[str], technology: str = "bulk", multiplexed: bool = False) -> list[str]:
    """By sample, lane and read (I1, I2, R1, R2), or by sample and mate; index reads go where unused."""
    lane = re.compile(r"(.+)_S(\d+)_L(\d+)_([IR][12])_\d+\.f")
    mate = re.compile(r"(.+)_([12])\.f")
    base = lambda n: n.rsplit("/", 1)[-1]
    if all(m := [lane.match(base(n)) for n in names]):
        keep_index = technology.upper() == "10XV1" or (multiplexed and technology.upper().startswith("SMARTSEQ"))
        order = {"I1": 0, "I2": 1, "R1": 2, "R2": 3}
        rows = sorted((int(x[2]), x[1], int(x[3]), order[x[4]], n) for x, n in zip(m, names, strict=True))
        return [n for *_, kind, n in rows if keep_index or kind > 1]
    if all(m := [mate.match(base(n)) for n in names]):
        return [n for *_, n in sorted((x[1], int(x[2]), n) for x, n in zip(m, names, strict=True))]
    return sorted(names)
