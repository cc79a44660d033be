"""Count matrices in long form: (barcode, vcrs_id, count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality as Q
from .fixed import materialised
from .number import ranked

PAIR = ["barcode", "vcrs_id"]


def weights(targets: Column, multimapping: bool) -> Column:
    """What a molecule adds to each of its targets: 1/n with multimapping, else 1 only if n is 1."""
    n = F.size(targets)
    return F.when(n == 0, 0.0).when(F.lit(multimapping), 1.0 / n).when(n == 1, 1.0).otherwise(0.0)


def shared_targets(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the targets that all of its reads have (rows: keys, targets)."""
    per = reads.select(*keys, F.explode(F.array_distinct("targets")).alias("target"))
    total = reads.groupBy(*keys).agg(F.count("*").alias("_reads"))
    hit = per.groupBy(*keys, "target").agg(F.count("*").alias("_n")).join(total, keys).filter("_n = _reads")
    return hit.groupBy(*keys).agg(F.array_sort(F.collect_list("target")).alias("targets"))


def count_matrix(reads: DataFrame, *, umis: bool, multimapping: bool = False) -> DataFrame:
    """Counts of reads (barcode, targets), or of molecules (barcode, umi: reads of one are intersected)."""
    molecules = shared_targets(reads, ["barcode", "umi"]) if umis else reads.select("barcode", "targets")
    added = molecules.select("barcode", weights(F.col("targets"), multimapping).alias("w"), F.explode("targets").alias("vcrs_id"))
    return added.filter("w > 0").groupBy(*PAIR).agg(F.sum("w").alias("count"))


def rescue_barcodes(reads: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Reads whose barcode is on the list, or becomes so by one change: the first by position and
    then by base A, C, G, T.  Others are dropped.  ``whitelist``: barcode."""
    known = whitelist.select(F.col("barcode").alias("_listed")).distinct()
    own = reads.select("barcode").distinct()
    here = F.col("barcode")
    spots = F.sequence(F.lit(1), F.length(here))
    near = own.select("barcode", F.explode(F.when(F.length(here) > 0, spots)).alias("at")).select(
        "barcode", "at", F.posexplode(F.array(*map(F.lit, "ACGT"))).alias("base_no", "base")
    )
    changed = F.concat(F.substring(here, F.lit(1), F.col("at") - 1), "base", F.substring(here, F.col("at") + 1, F.length(here)))
    candidates = near.select("barcode", changed.alias("_listed"), (F.col("at") * 4 + F.col("base_no")).alias("rank"))
    candidates = candidates.union(own.select("barcode", F.col("barcode"), F.lit(-1)))
    best = candidates.join(known, "_listed").groupBy("barcode").agg(F.min_by("_listed", "rank").alias("corrected"))
    return reads.join(best, "barcode").withColumn("barcode", F.col("corrected")).drop("corrected")


def recount_by_genome(
    reads: DataFrame, genome: DataFrame, genes: DataFrame, *, multimapping: bool = False, count_unaligned: bool = True, mistake_ratio: float | None = None,
) -> DataFrame:
    """Counts that agree with an alignment of the same reads to the genome.

    ``reads``: barcode, read_index, targets; ``genome``: barcode, read_index, genes; ``genes``:
    vcrs_id, genes (of that VCRS).  A target stays if one of its genes is among the read's genome
    genes, or if the read is not aligned there and ``count_unaligned`` holds, or if its gene's
    reads disagree more often than ``mistake_ratio``.  No target left: no count; several left and
    no multimapping: no count; else 1 for each.
    """
    keys = ["barcode", "read_index"]
    rows = reads.select(*keys, F.explode(F.array_distinct("targets")).alias("vcrs_id"))
    rows = rows.join(genes.select("vcrs_id", "genes"), "vcrs_id", "left").join(genome.select(*keys, F.col("genes").alias("seen")), keys, "left")
    seen = F.coalesce("seen", F.array().cast("array<string>"))
    own = F.coalesce("genes", F.array().cast("array<string>"))
    rows = rows.withColumns({"agrees": F.arrays_overlap(own, seen), "unaligned": F.size(seen) == 0})
    keep = F.col("agrees") | (F.col("unaligned") & F.lit(count_unaligned))
    if mistake_ratio is not None:
        per_gene = rows.select("genes", "agrees", "unaligned").select(F.explode("genes").alias("gene"), "agrees", "unaligned")
        share = per_gene.groupBy("gene").agg((F.count_if(~F.col("agrees") & ~F.col("unaligned")) / F.count("*")).alias("ratio"))
        wrong = share.filter(F.col("ratio") > mistake_ratio).select("gene")
        doubted = genes.select("vcrs_id", F.explode("genes").alias("gene")).join(wrong, "gene").select("vcrs_id", F.lit(True).alias("doubted")).distinct()
        rows = rows.join(doubted, "vcrs_id", "left")
        keep = keep | F.coalesce("doubted", F.lit(False))
    kept = rows.filter(keep).withColumn("left", F.count("*").over(Window.partitionBy(*keys)))
    return kept.filter(F.lit(multimapping) | (F.col("left") == 1)).groupBy(*PAIR).agg(F.count("*").cast("double").alias("count"))


def min_counts(matrix: DataFrame, least: float) -> DataFrame:
    """Counts below ``least`` are 0."""
    return matrix.withColumn("count", F.when(F.col("count") >= least, F.col("count")).otherwise(0.0))


def binary(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("count", F.when(F.col("count") > 0, 1.0).otherwise(0.0))


def drop_empty(matrix: DataFrame) -> DataFrame:
    return matrix.filter("count > 0")


def keep_variants(matrix: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Only, or all but, the variants in ``ids`` (vcrs_id)."""
    return matrix.join(ids.select("vcrs_id").distinct(), "vcrs_id", "left_semi" if keep else "left_anti")


def sum_rows(matrix: DataFrame) -> DataFrame:
    """All barcodes together, under the first one's name."""
    first = matrix.agg(F.min("barcode").alias("barcode"))
    return matrix.groupBy("vcrs_id").agg(F.sum("count").alias("count")).crossJoin(F.broadcast(first)).select("barcode", "vcrs_id", "count")


def merge_paired_barcodes(matrix: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Mates that were counted as single reads: the barcodes 2i and 2i + 1 become the i-th.

    ``barcodes``: barcode, index (from 0)."""
    good = barcodes.select(F.col("barcode").alias("corrected"), F.col("index").alias("_i"))
    mapped = barcodes.withColumn("_i", F.floor(F.col("index") / 2)).join(good, "_i").select("barcode", "corrected")
    return matrix.join(mapped, "barcode").groupBy(F.col("corrected").alias("barcode"), "vcrs_id").agg(F.sum("count").alias("count"))


def variant_totals(matrix: DataFrame) -> DataFrame:
    """Per variant: vcrs_count, vcrs_detected, number_obs (barcodes with it)."""
    return matrix.groupBy("vcrs_id").agg(
        F.sum("count").alias("vcrs_count"), (F.sum("count") > 0).alias("vcrs_detected"), F.count_if(F.col("count") > 0).alias("number_obs")
    )


def cell_totals(matrix: DataFrame) -> DataFrame:
    """Per barcode: total and variants detected."""
    return matrix.groupBy("barcode").agg(F.sum("count").alias("total"), F.count_if(F.col("count") > 0).alias("n_variants"))


def quality_filter(
    matrix: DataFrame, *, min_counts: float | str | None = None, min_variants: int | None = None, min_cells: int | None = None,
    mitochondrial: DataFrame | None = None, max_mitochondrial: float | None = None,
) -> DataFrame:
    """Barcodes with enough counts (``min_counts`` may be "knee") and variants and a small enough share of counts in ``mitochondrial``
    (vcrs_id), then variants in enough barcodes."""
    cells = cell_totals(matrix)
    if min_counts == "knee":
        min_counts = knee(matrix)
    if mitochondrial is not None and max_mitochondrial is not None:
        low = set_share(matrix, mitochondrial).filter(F.col("share") <= max_mitochondrial)
        cells = cells.join(low.select("barcode"), "barcode", "left_semi")
    if min_counts is not None:
        cells = cells.filter(F.col("total") >= min_counts)
    if min_variants is not None:
        cells = cells.filter(F.col("n_variants") >= min_variants)
    out = matrix.join(cells.select("barcode"), "barcode", "left_semi")
    if min_cells is not None:
        enough = out.filter("count > 0").groupBy("vcrs_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_cells)
        out = out.join(enough.select("vcrs_id"), "vcrs_id", "left_semi")
    return out


def ranked_totals(matrix: DataFrame) -> DataFrame:
    """Per barcode: total, and rank from 1 by falling totals; ties by barcode."""
    return ranked(cell_totals(matrix).select("barcode", "total"), F.desc("total"), "barcode", name="rank")


def knee(matrix: DataFrame) -> float:
    """The total at the knee of the totals in falling order: the one farthest below the line between the two ends, the first of several.

    Every total has its rank, and the distances are one aggregate; 0 without any barcode.
    """
    totals = materialised(ranked_totals(matrix))
    ends = totals.agg(F.count("*").alias("n"), F.max("total").alias("high"), F.min("total").alias("low")).first()
    if not ends["n"] or ends["high"] == ends["low"]:
        return float(ends["low"] or 0.0)
    n, high, low = ends["n"] - 1, float(ends["high"]), float(ends["low"])
    gap = (1 - (F.col("rank") - 1) / n) - (F.col("total") - low) / (high - low)
    return float(totals.agg(F.max_by("total", F.struct(gap, -F.col("rank")))).first()[0])


def set_share(matrix: DataFrame, members: DataFrame, name: str = "share") -> DataFrame:
    """Per barcode which share of its counts variants of a set have (``members``: vcrs_id), such as mitochondrial ones; 0 without counts."""
    flagged = matrix.join(members.select("vcrs_id", F.lit(True).alias("_in")).distinct(), "vcrs_id", "left")
    own = F.sum(F.when(F.col("_in"), F.col("count")).otherwise(0.0))
    return flagged.groupBy("barcode").agg(F.coalesce(F.try_divide(own, F.sum("count")), F.lit(0.0)).alias(name))


def per_million(matrix: DataFrame) -> DataFrame:
    totals = cell_totals(matrix).select("barcode", "total")
    return matrix.join(totals, "barcode").withColumn("cpm", Q.counts_per_million("count", "total")).drop("total")


def allele_fractions(mutant: DataFrame, wild: DataFrame) -> DataFrame:
    """vaf = mutant / (mutant + wild) of every pair that either matrix has; 0 where both are 0."""
    both = mutant.select(*PAIR, F.col("count").alias("m")).join(wild.select(*PAIR, F.col("count").alias("w")), PAIR, "full")
    m, w = F.coalesce("m", F.lit(0.0)), F.coalesce("w", F.lit(0.0))
    return both.select(*PAIR, Q.fraction(m, w).alias("vaf"))


def allele_fractions_across(mutant: DataFrame, wild: DataFrame) -> DataFrame:
    """Over all barcodes; null for a variant that ``wild`` doesn't have."""
    m = mutant.groupBy("vcrs_id").agg(F.sum("count").alias("m"))
    w = wild.groupBy("vcrs_id").agg(F.sum("count").alias("w"))
    return m.join(w, "vcrs_id", "left").select("vcrs_id", Q.fraction(F.col("m"), F.col("w"), None).alias("vaf"))


def gene_counts(matrix: DataFrame, genes: DataFrame) -> DataFrame:
    """Detected variants per gene, of variants with one gene (``genes``: vcrs_id, gene)."""
    detected = variant_totals(matrix).filter("vcrs_detected").join(genes, "vcrs_id")
    return detected.groupBy("gene").agg(F.count("*").alias("gene_count"))


def variant_ranks(matrix: DataFrame, top: int | None = None) -> DataFrame:
    """Per barcode its detected variants by falling count, ``rank`` from 1, ties by id; the first ``top`` of each."""
    order = Window.partitionBy("barcode").orderBy(F.desc("count"), "vcrs_id")
    out = matrix.filter("count > 0").withColumn("rank", F.row_number().over(order))
    return out if top is None else out.filter(F.col("rank") <= top)


def top_variants(matrix: DataFrame, n: int, by: str = "count") -> DataFrame:
    """The first n detected variants by count, or by barcodes and then count; ties by id."""
    totals = variant_totals(matrix).filter("vcrs_count > 0")
    order = [F.desc("vcrs_count")] if by == "count" else [F.desc("number_obs"), F.desc("vcrs_count")]
    return totals.orderBy(*order, "vcrs_id").limit(n)


def single_locus_records(totals: DataFrame, records: DataFrame, header: str = "vcrs_header") -> DataFrame:
    """VCF rows of detected variants: headers whose variants all name one locus (``records``: ID,
    CHROM, POS, REF, ALT); AO is the count and NS the barcodes."""
    each = totals.filter("vcrs_count > 0").select(header, "vcrs_count", "number_obs", F.explode(F.split(header, ";")).alias("ID"))
    each = each.join(records, "ID")
    locus = F.struct("CHROM", "POS", "REF", "ALT")
    one = each.groupBy(header).agg(
        F.min(locus).alias("l"), F.max(locus).alias("h"), F.max("vcrs_count").alias("AO"), F.max("number_obs").alias("NS")
    )
    return one.filter("l = h").select("l.*", F.col(header).alias("ID"), "AO", "NS")
