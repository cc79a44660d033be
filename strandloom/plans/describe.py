"""The columns that ``info`` can add, in groups that share a join; groups nobody asks for are not planned."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hgvs as H
from ..operators import info as I
from ..operators import kmers as K
from ..operators import ranges as R


@dataclass
class Inputs:
    """``vcrs``: vcrs_id, vcrs_header, vcrs_sequence.  The others may be missing.

    ``reference`` and ``transcriptome``: seq_id, sequence; ``junctions``: seq, position; ``variants``:
    header, seq_id, start, end; ``genes``: header, gene_name; ``cdna_vcrs`` and ``genome_vcrs``:
    header, vcrs_sequence of the same variants by either coordinates.
    """

    vcrs: DataFrame
    k: int = 59
    stranded: bool = False
    near: int = 10
    reference: DataFrame | None = None
    transcriptome: DataFrame | None = None
    junctions: DataFrame | None = None
    variants: DataFrame | None = None
    genes: DataFrame | None = None
    cdna_vcrs: DataFrame | None = None
    genome_vcrs: DataFrame | None = None

    def sides(self) -> list[tuple[str, DataFrame]]:
        return [(n, r) for n, r in (("genome", self.reference), ("cdna", self.transcriptome)) if r is not None]

    def by_header(self, rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """``rows`` (header and more) brought together for each merged header."""
        each = I.explode_headers(self.vcrs.select("vcrs_id", "vcrs_header")).withColumnRenamed("vcrs_header_individual", "header")
        return each.join(rows, "header", "left").groupBy("vcrs_id").agg(*(c.alias(n) for n, c in columns.items()))


def overlaps(x: Inputs) -> DataFrame:
    found = K.kmer_overlaps(x.vcrs, x.k, x.stranded, "vcrs_id", "vcrs_sequence")
    n = F.size("others")
    return found.select(
        F.col("id").alias("vcrs_id"), F.col("kmers").alias("number_of_kmers_with_overlap_to_other_VCRSs"), F.col("others").alias("VCRSs_with_overlapping_kmers"),
        n.alias("number_of_other_VCRSs_with_overlapping_kmers"), (n > 0).alias("kmer_overlap_with_other_VCRSs"),
    )


def substrings(x: Inputs) -> DataFrame:
    pairs = K.substring_relations(x.vcrs, x.stranded, "vcrs_id", "vcrs_sequence")
    inside, around = "VCRSs_for_which_this_VCRS_is_a_substring", "VCRSs_for_which_this_VCRS_is_a_superstring"
    above = pairs.groupBy(F.col("id").alias("vcrs_id")).agg(F.array_sort(F.collect_list("inside")).alias(inside))
    below = pairs.groupBy(F.col("inside").alias("vcrs_id")).agg(F.array_sort(F.collect_list("id")).alias(around))
    both = x.vcrs.select("vcrs_id").join(above, "vcrs_id", "left").join(below, "vcrs_id", "left")
    flags = {"VCRS_is_a_substring_of_another_VCRS": F.col(inside).isNotNull(), "VCRS_is_a_superstring_of_another_VCRS": F.col(around).isNotNull()}
    return both.withColumns(flags)


def _over_sides(x: Inputs, name: str, counted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Counts (id, n) by each reference, with flags, and both together."""
    out, total = x.vcrs.select("vcrs_id"), F.lit(0)
    for side, reference in x.sides():
        n = f"{name}_count_{side}"
        out = out.join(counted(reference).select(F.col("id").alias("vcrs_id"), F.col("n").alias(n)), "vcrs_id", "left").fillna(0, [n])
        out = out.withColumn(f"{name}_{side}", F.col(n) > 0)
        total = total + F.col(n)
    return out.withColumns({f"{name}_count_total": total, name: total > 0})


def aligned(x: Inputs) -> DataFrame:
    hits = lambda ref: K.align_to_reference(x.vcrs, ref, x.k, x.stranded, "vcrs_id", "vcrs_sequence").select("id", F.col("hits").alias("n"))
    return _over_sides(x, "alignment_to_reference", hits)


def substring_aligned(x: Inputs) -> DataFrame:
    """How many of the places where a VCRS has a k-mer of a reference hold all of it."""

    def counted(reference: DataFrame) -> DataFrame:
        places = K.distractors(x.vcrs, reference, x.k, x.stranded, id_col="vcrs_id", seq_col="vcrs_sequence")
        return K.contexts_with_sequence(x.vcrs, places, x.stranded, "vcrs_id", "vcrs_sequence")

    return _over_sides(x, "substring_alignment_to_reference", counted)


def pseudoaligned(x: Inputs) -> DataFrame:
    reads = x.vcrs.select("vcrs_id", F.col("vcrs_sequence").alias("sequence"))
    hit = K.pseudoalign_to(reads, x.reference, x.k, stranded=x.stranded, keys=["vcrs_id"], id_col="seq_id").select("vcrs_id", F.lit(True).alias("_p"))
    flag = F.coalesce("_p", F.lit(False)).alias("pseudoaligned_to_reference")
    return x.vcrs.select("vcrs_id").join(hit, "vcrs_id", "left").select("vcrs_id", flag)


def pseudoaligned_only(x: Inputs) -> DataFrame:
    both = pseudoaligned(x).join(aligned(x).select("vcrs_id", "alignment_to_reference"), "vcrs_id")
    only = F.col("pseudoaligned_to_reference") & ~F.col("alignment_to_reference")
    return both.select("vcrs_id", only.alias("pseudoaligned_to_reference_despite_not_truly_aligning"))


def nearby(x: Inputs) -> DataFrame:
    lists = F.array_sort(F.array_distinct(F.flatten(F.collect_list("nearby_variants"))))
    found = x.by_header(R.nearby_variants(x.variants, x.k), {"nearby_variants": lists})
    n = F.size("nearby_variants")
    return found.withColumns({"nearby_variants_count": n, "has_a_nearby_variant": n > 0})


def splice(x: Inputs) -> DataFrame:
    name = "distance_to_nearest_splice_junction"
    found = x.by_header(R.nearest_junction(x.variants, x.junctions, near=x.near), {name: F.min(name)})
    return found.withColumn(f"is_near_splice_junction_{x.near}", F.col(name) <= x.near)


def gene_totals(x: Inputs) -> DataFrame:
    name = "number_of_variants_in_this_gene_total"
    return x.by_header(I.gene_totals(x.genes), {name: F.max(name)})


def named_genes(x: Inputs) -> DataFrame:
    each = F.struct("order_in_vcrs", F.coalesce(H.header_with_gene("header", "gene_name"), "header").alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda e: e["h"]), ";")
    return x.by_header(x.genes, {"header_with_gene_name": joined})


def same_by_either(x: Inputs) -> DataFrame:
    same = I.compare_cdna_genome(x.cdna_vcrs, x.genome_vcrs).select("header", "cdna_and_genome_same")
    return x.by_header(same, {"cdna_and_genome_same": F.every("cdna_and_genome_same")})


def _sided(name: str) -> tuple[str, ...]:
    return (name, *(f"{name}_{s}" for s in ("genome", "cdna")), *(f"{name}_count_{s}" for s in ("total", "genome", "cdna")))


#: Columns of each group, the inputs that it needs (any of those joined by '|'), and what makes it.
GROUPS: list[tuple[tuple[str, ...], tuple[str, ...], Callable[[Inputs], DataFrame]]] = [
    (("number_of_kmers_with_overlap_to_other_VCRSs", "VCRSs_with_overlapping_kmers", "number_of_other_VCRSs_with_overlapping_kmers", "kmer_overlap_with_other_VCRSs"), (), overlaps),
    (
        ("VCRSs_for_which_this_VCRS_is_a_substring", "VCRSs_for_which_this_VCRS_is_a_superstring", "VCRS_is_a_substring_of_another_VCRS", "VCRS_is_a_superstring_of_another_VCRS"),
        (), substrings,
    ),
    (_sided("alignment_to_reference"), ("reference|transcriptome",), aligned),
    (_sided("substring_alignment_to_reference"), ("reference|transcriptome",), substring_aligned),
    (("pseudoaligned_to_reference",), ("reference",), pseudoaligned),
    (("pseudoaligned_to_reference_despite_not_truly_aligning",), ("reference",), pseudoaligned_only),
    (("nearby_variants", "nearby_variants_count", "has_a_nearby_variant"), ("variants",), nearby),
    (("distance_to_nearest_splice_junction",), ("variants", "junctions"), splice),
    (("number_of_variants_in_this_gene_total",), ("genes",), gene_totals),
    (("header_with_gene_name",), ("genes",), named_genes),
    (("cdna_and_genome_same",), ("cdna_vcrs", "genome_vcrs"), same_by_either),
]


def info(vcrs: DataFrame, columns="all", **inputs) -> DataFrame:
    """``vcrs`` with the wanted columns.  ``inputs`` are the fields of ``Inputs``.

    Of ``all`` columns those whose input is missing are left out; by name, that is an error.
    """
    x = Inputs(vcrs, **inputs)
    every = columns == "all" or list(columns) == ["all"]
    known = set(I.EXPRESSIONS) | {c for names, _, _ in GROUPS for c in names} | {f"is_near_splice_junction_{x.near}"}
    wanted = set(I.EXPRESSIONS) if every else set(columns)
    if unknown := wanted - known:
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    plain = [c for c in I.EXPRESSIONS if c in wanted]
    out = I.with_expressions(vcrs, plain) if plain else vcrs
    for names, needs, make in GROUPS:
        asked = wanted & ({*names, f"is_near_splice_junction_{x.near}"} if make is splice else set(names))
        ready = all(any(getattr(x, n) is not None for n in need.split("|")) for need in needs)
        if asked and not ready:
            raise ValueError(f"{', '.join(sorted(asked))}: an input for this is missing ({', '.join(needs)})")
        if asked or (every and ready):
            out = out.join(make(x), "vcrs_id", "left")
    return out
