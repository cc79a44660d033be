"""HGVS variant names, and variants of VCF records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import _col, complement, lenient_reverse_complement, let, reverse_complement

#: Fixed patterns of variant names and headers.
PATTERN = r"(?:c|g)\.([0-9_\-\+\*\(\)\?]+)([a-zA-Z>]+)"
SEQ_ID_PATTERN = r"(ENST\d+|(?:[1-9]|1[0-9]|2[0-3]|X|Y|MT)\d+)"
STRICT_HEADER = rf"^{SEQ_ID_PATTERN}:{PATTERN}$"
GENERAL_HEADER = rf"^[A-Za-z0-9_-]+:{PATTERN}$"
TYPES = ["substitution", "deletion", "duplication", "insertion", "inversion", "delins"]


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def variant_positions(variant) -> Column:
    """'35', '35_40' and the like; null without a match."""
    return _nonempty(F.regexp_extract(_col(variant), PATTERN, 1))


def variant_change(variant) -> Column:
    """'G>A', 'delinsAA' and the like; null without a match."""
    return _nonempty(F.regexp_extract(_col(variant), PATTERN, 2))


def positions_start(positions) -> Column:
    return F.split_part(_col(positions), F.lit("_"), F.lit(1)).try_cast("bigint")


def positions_end(positions) -> Column:
    """The second position, or the first where there is one only."""
    second = _nonempty(F.split_part(_col(positions), F.lit("_"), F.lit(2)))  # try_cast of '' would raise and catch
    return F.coalesce(second.try_cast("bigint"), positions_start(positions))


def change_type(change) -> Column:
    """One of ``TYPES``, else 'unknown', by what ``variant_change`` gives."""
    change = _col(change)
    return (
        F.when(F.contains(change, F.lit(">")), "substitution")
        .when(F.contains(change, F.lit("delins")), "delins")
        .when(F.contains(change, F.lit("del")), "deletion")
        .when(F.contains(change, F.lit("ins")), "insertion")
        .when(F.contains(change, F.lit("dup")), "duplication")
        .when(F.contains(change, F.lit("inv")), "inversion")
        .otherwise("unknown")
    )


def variant_start(variant) -> Column:
    return positions_start(variant_positions(variant))


def variant_end(variant) -> Column:
    """The second position, or the first where there is one only."""
    return positions_end(variant_positions(variant))


def variant_type(variant) -> Column:
    """One of ``TYPES``, else 'unknown'."""
    return let(variant_change(variant), change_type)


def has_strict_header(header) -> Column:
    """Whether a header is one transcript or chromosome with one variant, and nothing else."""
    return _col(header).rlike(STRICT_HEADER)


def has_header(header) -> Column:
    """Whether a header is any sequence's id with one variant, and nothing else."""
    return _col(header).rlike(GENERAL_HEADER)


def header_type(header) -> Column:
    """The type that all of a merged header's variants have, else 'mixed'; null for null."""
    kinds = F.array_distinct(F.transform(F.split(_col(header), ";"), lambda h: variant_type(h)))
    return F.when(_col(header).isNotNull(), F.when(F.size(kinds) == 1, kinds[0]).otherwise("mixed"))


def variant_source(variant, transcript: str = "transcriptome", genome: str = "genome") -> Column:
    v = F.regexp_replace(_col(variant), "^[^:]*:", "")
    return F.when(v.startswith("c."), transcript).when(v.startswith("g."), genome).otherwise("unknown")


def plain_seq_id(value) -> Column:
    """'1.0' becomes '1'; other ids stay."""
    value = _col(value).cast("string")
    return F.when(value.rlike(r"^\d+\.0+$"), F.split_part(value, F.lit("."), F.lit(1))).otherwise(value)


def without_version(value) -> Column:
    return F.split_part(_col(value), F.lit("."), F.lit(1))


def fasta_id(title) -> Column:
    """A FASTA title up to its first space, and then up to its first dot."""
    return F.split_part(F.split_part(_col(title), F.lit(" "), F.lit(1)), F.lit("."), F.lit(1))


def vcf_type(ref, alt) -> Column:
    """The variant type of a VCF record by its alleles."""
    ref, alt = _col(ref), _col(alt)
    r, a = F.length(ref), F.length(alt)
    return (
        F.when((r == 1) & (a == 1), "substitution")
        .when((r > 1) & (a == 1), "deletion")
        .when((r == 1) & (a == 2) & (F.substring(alt, 2, 1) == ref), "duplication")
        .when((r == 1) & (a > 1), "insertion")
        .when((r > 1) & (a > 1) & (ref == reverse_complement(alt)), "inversion")
        .when((r > 1) & (a > 1), "delins")
        .otherwise("unknown")
    )


def vcf_variant(pos, ref, alt) -> Column:
    """The genomic HGVS name of a VCF record; 'g.unknown' where there is none."""
    pos, ref, alt = _col(pos), _col(ref), _col(alt)
    kind, r = vcf_type(ref, alt), F.length(ref)
    p, last = pos.cast("string"), (pos + r - 1).cast("string")
    name = lambda *parts: F.concat(F.lit("g."), *(F.lit(x) if isinstance(x, str) else x for x in parts))
    deletion = (
        F.when((pos == 1) & (r == 2), "g.1del")
        .when(pos == 1, name("1_", (r - 1).cast("string"), "del"))
        .when(r == 2, name((pos + 1).cast("string"), "del"))
        .otherwise(name((pos + 1).cast("string"), "_", last, "del"))
    )
    insertion = F.when(pos != 1, name(p, "_", (pos + 1).cast("string"), "ins", F.substring(alt, F.lit(2), F.length(alt))))
    return F.coalesce(
        F.when(kind == "substitution", name(p, ref, ">", alt))
        .when(kind == "deletion", deletion)
        .when(kind == "insertion", insertion)
        .when(kind == "delins", name(p, "_", last, "delins", alt))
        .when(kind == "duplication", name(p, "dup"))
        .when(kind == "inversion", name(p, "_", last, "inv")),
        F.lit("g.unknown"),
    )


def long_duplication(pos, ref, alt, before) -> Column:
    """'g.start_POSdup' where an insertion repeats ``before``, the bases up to it; else null."""
    pos, ref, alt, before = map(_col, (pos, ref, alt, before))
    n = F.length(alt) - 1
    start = pos - n + 1
    same = (vcf_type(ref, alt) == "insertion") & (start >= 1) & (F.substring(alt, F.lit(2), n) == before) & (F.substring(alt, -1, 1) == ref)
    return F.when(same, F.concat(F.lit("g."), start.cast("string"), F.lit("_"), pos.cast("string"), F.lit("dup")))


def vcf_long_duplication(pos, ref, alt, seq) -> Column:
    """``long_duplication`` by the whole sequence."""
    n = F.length(_col(alt)) - 1
    return long_duplication(pos, ref, alt, F.substring(_col(seq), (_col(pos) - n + 1).cast("int"), n.cast("int")))


def repair_strand(variant, strand) -> Column:
    """A genomic name as read on the plus strand: on '-', bases are complemented, insertions reversed."""
    variant, strand = _col(variant), _col(strand)
    places, change = variant_positions(variant), variant_change(variant)
    inserted = F.regexp_extract(change, "ins([A-Za-z]+)$", 1)
    turned = F.concat(F.regexp_replace(change, "ins[A-Za-z]+$", "ins"), lenient_reverse_complement(inserted))
    fixed = F.when(F.contains(change, F.lit(">")), complement(change)).when(F.contains(change, F.lit("ins")), turned).otherwise(change)
    return F.when((strand == "-") & places.isNotNull(), F.concat(F.lit("g."), places, fixed)).otherwise(variant)


def header_with_gene(header, gene, gene_first: bool = False) -> Column:
    """'id(gene):variant', or 'gene(id):variant'."""
    seq = F.split_part(_col(header), F.lit(":"), F.lit(1))
    var = F.split_part(_col(header), F.lit(":"), F.lit(2))
    a, b = (_col(gene), seq) if gene_first else (seq, _col(gene))
    return F.concat(a, F.lit("("), b, F.lit("):"), var)


def merged_count(header) -> Column:
    """How many variants a header names."""
    return F.regexp_count(_col(header), F.lit(";")) + 1
