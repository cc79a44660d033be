"""Assigned reads: BUS tables joined to names, mates and molecules put together, and what headers say.

A read is a row with barcode, umi, read_index and lists of targets; targets have genes (``genes``),
and an alignment of the same reads to a genome gives genes as well (``genome_genes``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hgvs as H
from .ranges import first_interval

READ = ["barcode", "read_index"]


def mapped_names(df: DataFrame, key: str, names: str, lookup: DataFrame, *, strip_versions: bool = False) -> DataFrame:
    """(key, names) with every name replaced by its ``lookup`` (name, label); names without one stay.

    The order of the list is kept.  ``key`` names a row.
    """
    each = df.select(key, F.posexplode_outer(names).alias("_at", "name"))
    table = lookup.select("name", "label").dropDuplicates(["name"])
    if strip_versions:
        each = each.withColumn("name", H.without_version("name"))
        table = table.select(H.without_version("name").alias("name"), H.without_version("label").alias("label")).dropDuplicates(["name"])
    joined = each.join(table, "name", "left").select(key, "_at", F.coalesce("label", "name").alias("_name"))
    packed = F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_name"))))
    return joined.groupBy(key).agg(F.transform(packed, lambda x: x["_name"]).alias(names))


def bus_reads(
    bus: DataFrame, ec: DataFrame, transcripts: DataFrame, *, t2g: DataFrame | None = None, fastq: DataFrame | None = None,
    multimapping: bool = False, distractor: str | None = None, strip_versions: bool = False,
) -> DataFrame:
    """The rows of a BUS table (barcode, umi, ec, read_index) with transcript_names, gene_names,
    counted_in_count_matrix and count_matrix_value.

    ``ec``: ec, transcript_ids; ``transcripts``: index, name; ``t2g``: name, label; ``fastq``:
    read_index, barcode, fastq_header.  Names are put together once for each equivalence class.  A
    read counts if it has one gene, or with ``multimapping`` any, each for its share; one that has
    the ``distractor`` doesn't count.
    """
    ids = ec.select("ec", F.posexplode("transcript_ids").alias("_at", "index")).join(transcripts, "index", "left")
    packed = F.array_sort(F.collect_list(F.struct("_at", "name")))
    named = ids.groupBy("ec").agg(F.transform(packed, lambda x: x["name"]).alias("transcript_names"))
    if t2g is None:
        named = named.withColumn("gene_names", F.col("transcript_names"))
    else:
        genes = mapped_names(named.withColumn("gene_names", F.col("transcript_names")), "ec", "gene_names", t2g, strip_versions=strip_versions)
        named = named.join(genes.withColumn("gene_names", F.array_sort(F.array_distinct("gene_names"))), "ec")
    out = bus.join(named, "ec", "left")
    if fastq is not None:
        out = out.join(fastq, ["read_index", "barcode"], "left")
    n = F.size("gene_names")
    one = F.lit(True) if multimapping else n == 1
    free = ~F.array_contains("gene_names", distractor) if distractor is not None else F.lit(True)
    out = out.withColumn("counted_in_count_matrix", F.coalesce(one & free & (n > 0), F.lit(False)))
    return out.withColumn("count_matrix_value", F.when(F.col("counted_in_count_matrix"), 1.0 / n).otherwise(0.0))


def without_padding(reads: DataFrame, size: int) -> DataFrame:
    """Barcodes as their last ``size`` bases."""
    return reads.withColumn("barcode", F.right("barcode", F.lit(size)))


def paired_genes(reads: DataFrame, *, drop_different: bool = False) -> DataFrame:
    """Mates that were aligned to the genome one by one: both get the genes of either.

    ``reads``: barcode, read_index, genome_genes and more.  With ``drop_different`` reads go whose
    mates have genes, all of them, and none in common.
    """
    genes = F.coalesce("genome_genes", F.array().cast("array<string>"))
    each = reads.select(*READ, F.explode_outer(F.array_distinct(genes)).alias("_gene"), (F.size(genes) > 0).alias("_has"))
    per_gene = each.groupBy(*READ, "_gene").agg(F.count("*").alias("_n"))
    per_read = reads.select(*READ, (F.size(genes) > 0).alias("_has")).groupBy(*READ).agg(F.count("*").alias("_mates"), F.every("_has").alias("_all"))
    joined = per_read.join(per_gene.filter("_gene IS NOT NULL"), READ, "left")
    union = joined.groupBy(*READ, "_mates", "_all").agg(F.array_sort(F.collect_list("_gene")).alias("_union"), F.max("_n").alias("_common"))
    if drop_different:
        union = union.filter(~(F.col("_all") & (F.col("_mates") > 1) & (F.col("_common") < F.col("_mates"))))
    out = reads.drop("genome_genes").join(union.select(*READ, F.col("_union").alias("genome_genes")), READ)
    return out.select(*reads.columns)


def molecules(reads: DataFrame) -> DataFrame:
    """One row per (barcode, umi): read_indexes, targets and their genes (in the order in which they
    first come), genome_genes (the union) and aligned_to_genome.

    ``reads``: barcode, umi, read_index, targets, genes (one per target), genome_genes.  Reads of a
    molecule share its gene and not its place, so its targets are a union and no intersection.
    """
    cell = ["barcode", "umi"]
    each = reads.select(*cell, "read_index", F.posexplode(F.arrays_zip("targets", "genes")).alias("_at", "_t"))
    first = each.groupBy(*cell, F.col("_t.targets").alias("target")).agg(F.min(F.struct("read_index", "_at", F.col("_t.genes").alias("gene"))).alias("_f"))
    packed = F.array_sort(F.collect_list(F.struct("_f", "target")))
    targets = first.groupBy(*cell).agg(packed.alias("_p"))
    targets = targets.select(*cell, F.transform("_p", lambda x: x["target"]).alias("targets"), F.transform("_p", lambda x: x["_f"]["gene"]).alias("genes"))
    seen = reads.select(*cell, F.explode("genome_genes").alias("gene")).groupBy(*cell).agg(F.array_sort(F.collect_set("gene")).alias("genome_genes"))
    whole = reads.groupBy(*cell).agg(F.array_sort(F.collect_list("read_index")).alias("read_indexes"))
    out = whole.join(targets, cell, "left").join(seen, cell, "left")
    empty = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("targets", "genes", "genome_genes")}
    return out.withColumns(empty).withColumn("aligned_to_genome", F.size("genome_genes") > 0)


def changed_counts(reads: DataFrame, *, multimapping: bool = False, was_multimapping: bool = False) -> DataFrame:
    """One row: counts_added, counts_removed and reads_changed by a recount.

    ``reads``: before and after, how many targets a read had and has.  With ``multimapping`` a read
    with several targets counts for each of them, else not at all; ``was_multimapping`` tells which
    held before.
    """
    was = F.when((F.col("before") == 1) | F.lit(was_multimapping), F.col("before")).otherwise(0)
    now = F.when((F.col("after") == 1) | F.lit(multimapping), F.col("after")).otherwise(0)
    fewer = F.col("after") < F.col("before")
    changed = fewer & ((now > 0) | ((F.col("after") == 0) & (was > 0)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return reads.agg(
        total(F.greatest(now - was, F.lit(0))).alias("counts_added"),
        total(F.greatest(was - now, F.lit(0))).alias("counts_removed"),
        total(changed.cast("int")).alias("reads_changed"),
    )


def without_double_counts(matrix: DataFrame, reads: DataFrame, *, split_at_n: bool = False, mates: bool = False, only: DataFrame | None = None) -> DataFrame:
    """``matrix`` less what pieces of one read, or its mates, have counted twice.

    ``reads``: barcode, fastq_header, ec, targets, counted_in_count_matrix.  Pieces are named
    ``read:from-to``, mates end in two characters such as /1.  Of pieces with one barcode and
    equivalence class one counts.  ``only`` (vcrs_id) limits this to some targets, such as insertions.
    """
    name = F.col("fastq_header")
    name = F.regexp_replace(name, ":[^:]*$", "") if split_at_n else name
    name = F.left(name, F.length(name) - 2) if mates else name
    counted = reads.filter("counted_in_count_matrix").select("barcode", "ec", name.alias("_read"), "targets")
    extra = counted.groupBy("barcode", "ec", "_read").agg((F.count("*") - 1).alias("_extra"), F.first("targets").alias("targets")).filter("_extra > 0")
    less = extra.select("barcode", F.explode("targets").alias("vcrs_id"), "_extra")
    if only is not None:
        less = less.join(only.select("vcrs_id").distinct(), "vcrs_id", "left_semi")
    less = less.groupBy("barcode", "vcrs_id").agg(F.sum("_extra").alias("_extra"))
    out = matrix.join(less, ["barcode", "vcrs_id"], "left")
    return out.withColumn("count", F.col("count") - F.coalesce("_extra", F.lit(0))).select(*matrix.columns)


def header_information(
    each: DataFrame, *, header: str = "vcrs_header_individual", t2g: DataFrame | None = None, genes: DataFrame | None = None, source: str | None = None,
) -> DataFrame:
    """``each`` (one variant per row) with seq_ID, mutation, positions, variant_source and gene_id.

    A transcript's gene comes from ``t2g`` (name, label), without one it is the transcript; a
    place's from the first of ``genes`` (seq_id, start, end, gene_id, ordinal) that holds it.
    """
    parts = {"seq_ID": H.without_version(F.split_part(F.col(header), F.lit(":"), F.lit(1))), "mutation": F.split_part(F.col(header), F.lit(":"), F.lit(2))}
    out = each.withColumns({n: c for n, c in parts.items() if n not in each.columns})
    names = {
        "nucleotide_positions": H.variant_positions("mutation"), "actual_variant": H.variant_change("mutation"),
        "start_variant_position": H.variant_start("mutation"), "end_variant_position": H.variant_end("mutation"),
        "variant_source": F.lit(source) if source else H.variant_source("mutation"),
    }
    out = out.withColumns({n: c for n, c in names.items() if n not in each.columns})
    if "gene_id" in each.columns or (t2g is None and genes is None):
        return out
    labels = {}
    if t2g is not None:
        table = t2g.select(H.without_version("name").alias("seq_ID"), H.without_version("label").alias("_label")).dropDuplicates(["seq_ID"])
        out = out.join(table, "seq_ID", "left")
        labels["transcriptome"] = F.coalesce("_label", "seq_ID")
    if genes is not None:
        out = first_interval(out.withColumn("_pos", F.col("start_variant_position")), genes.withColumnRenamed("seq_id", "seq_ID").withColumnRenamed("gene_id", "_gene"), seq="seq_ID", pos="_pos", label="_gene")
        labels["genome"] = F.col("_gene")
    gene = F.lit(None).cast("string")
    for name, label in labels.items():
        gene = F.when(F.col("variant_source") == name, label).otherwise(gene)
    out = out.withColumn("gene_id", gene).drop("_label", "_pos", "_gene")
    return out.withColumn("vcrs_header_with_gene_name", H.header_with_gene(header, "gene_id", gene_first=True))


def with_variants(each: DataFrame, variants: DataFrame, *, on: str = "vcrs_id_individual", id_col: str = "vcrs_header", columns: list[str] | None = None) -> DataFrame:
    """``each`` with the columns of ``variants`` whose ``id_col`` it names; clashing ones end in _variant."""
    wanted = [c for c in variants.columns if c != id_col and (columns is None or c in columns)]
    clash = lambda c: f"{c}_variant" if c in each.columns else c
    side = variants.select(F.col(id_col).alias("_id"), *(F.col(c).alias(clash(c)) for c in wanted))
    return each.join(side, each[on] == side["_id"], "left").drop("_id")


def with_metadata(totals: DataFrame, metadata: DataFrame, key: str = "vcrs_id") -> DataFrame:
    """``totals`` with the columns of ``metadata`` that it lacks; of rows with one key, any one."""
    new = [c for c in metadata.columns if c not in totals.columns]
    return totals.join(metadata.select(key, *new).dropDuplicates([key]), key, "left")


def named_targets(reads: DataFrame, variants: DataFrame, key: str = "read_index") -> DataFrame:
    """``reads`` with the headers (vcrs_names) and genes (genes_vcrs) of their targets, in order.

    ``variants``: vcrs_id, vcrs_header, gene_id.  A target that isn't there keeps its own name.
    """
    each = reads.select(key, F.posexplode("targets").alias("_at", "vcrs_id")).join(variants.select("vcrs_id", "vcrs_header", "gene_id"), "vcrs_id", "left")
    row = F.struct("_at", F.coalesce("vcrs_header", "vcrs_id").alias("h"), F.col("gene_id").alias("g"))
    names = each.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_n"))
    out = reads.join(names, key, "left")
    return out.withColumns({"vcrs_names": F.transform("_n", lambda x: x["h"]), "genes_vcrs": F.transform("_n", lambda x: x["g"])}).drop("_n")


def mates_side_by_side(reads: DataFrame, header: str = "fastq_header", genes: str = "genes") -> DataFrame:
    """Mates /1 and /2 in one row: name, genes_1, genes_2, map_to_different_genes."""
    base = F.left(header, F.length(header) - 2)
    side = lambda s: reads.filter(F.col(header).endswith(s)).select(base.alias("name"), F.col(genes).alias(f"genes_{s[1]}"))
    both = side("/1").join(side("/2"), "name")
    full = (F.size("genes_1") > 0) & (F.size("genes_2") > 0)
    return both.withColumn("map_to_different_genes", F.coalesce(full & ~F.arrays_overlap("genes_1", "genes_2"), F.lit(False)))


def spliced_headers(seqs: DataFrame, header: str = "header") -> DataFrame:
    """One row: sequences whose merged headers are all spliced, all unspliced, or of both kinds."""
    names = F.split(header, ";")
    raw, done = F.exists(names, lambda h: F.contains(h, F.lit("unspliced"))), F.exists(names, lambda h: ~F.contains(h, F.lit("unspliced")))
    return seqs.agg(F.count_if(done & ~raw).alias("spliced_only"), F.count_if(raw & ~done).alias("unspliced_only"), F.count_if(raw & done).alias("both"))


def detected_variants(matrix: DataFrame, least: float = 1) -> DataFrame:
    """vcrs_id of the variants with so many counts or more."""
    return matrix.groupBy("vcrs_id").agg(F.sum("count").alias("_n")).filter(F.col("_n") >= least).select("vcrs_id")


def reference_headers(reads: DataFrame, references: DataFrame, header: str = "header") -> DataFrame:
    """``reads`` (read_header) with reference_header: the merged header that names them, the first in
    order; without one, their own."""
    each = references.select(F.col(header).alias("_whole"), F.explode(F.split(header, ";")).alias("read_header"))
    first = each.groupBy("read_header").agg(F.min("_whole").alias("reference_header"))
    return reads.join(first, "read_header", "left").withColumn("reference_header", F.coalesce("reference_header", "read_header"))


def sequences_of(seqs: DataFrame, ids: DataFrame, *, keep: bool = True, id_col: str = "seq_id") -> DataFrame:
    """The sequences whose id is in ``ids``, or with ``keep=False`` the others."""
    return seqs.join(ids.select(id_col).distinct(), id_col, "left_semi" if keep else "left_anti")


def not_distracted(reads: DataFrame, targets: DataFrame, dlist: DataFrame, k: int) -> DataFrame:
    """``reads`` (read_index, targets) that a distractor has taken and that get back: those of whose
    targets none shares a k-mer with a distractor of its own.

    ``targets``: vcrs_id, sequence; ``dlist``: id (of the target), sequence.
    """
    from .kmers import exploded

    own = exploded(targets, k, False, "vcrs_id", "sequence").select("id", "kmer").distinct()
    shared = own.join(exploded(dlist, k, False, "id", "sequence").select("id", "kmer").distinct(), ["id", "kmer"]).select(F.col("id").alias("vcrs_id")).distinct()
    taken = reads.select("read_index", F.explode("targets").alias("vcrs_id")).join(shared, "vcrs_id").select("read_index").distinct()
    return reads.join(taken, "read_index", "left_anti")


def one_wild_type(vcrs: DataFrame, column: str = "wt_sequences") -> DataFrame:
    """The rows whose list of wild-type sequences has one distinct value."""
    return vcrs.filter(F.size(F.array_distinct(column)) == 1)
