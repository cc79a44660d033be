"""Functions on nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bases and their complements.
BASES, COMPLEMENTS = "ACGTNacgtn.", "TGCANtgcan."
#: Fixed values of the lenient complement: U pairs like T; gap marks and ">" stay.
LENIENT, LENIENT_COMPLEMENTS = "ATUCGNatucgn*.->", "TAAGCNtaagcn*.->"
#: Bases in which common prefixes are looked for one by one.
NEAR = 4
#: The standard genetic code, bases in the order T, C, A, G (fixed values).
CODON_BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """``f(value)``, with ``value`` worked out once however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def reverse_complement(seq) -> Column:
    """Null stays null; characters without a complement stay as they are."""
    return F.reverse(F.translate(_col(seq), BASES, COMPLEMENTS))


def lenient_reverse_complement(seq) -> Column:
    """Characters without a complement become N; U becomes A."""
    known = F.regexp_replace(_col(seq), r"[^ATUCGNatucgn*.\->]", "N")
    return F.reverse(F.translate(known, LENIENT, LENIENT_COMPLEMENTS))


def complement(seq) -> Column:
    return F.translate(_col(seq), LENIENT, LENIENT_COMPLEMENTS)


def base_at(seq, pos) -> Column:
    """The base at a 0-based position; null outside."""
    return F.when((_col(pos) >= 0) & (_col(pos) < F.length(_col(seq))), F.substring(_col(seq), (_col(pos) + 1).cast("int"), F.lit(1)))


def slice_between(seq, start, end) -> Column:
    """Bases start .. end - 1 (0-based)."""
    size = F.greatest(_col(end) - F.greatest(_col(start), F.lit(0)), F.lit(0))
    return F.substring(_col(seq), (F.greatest(_col(start), F.lit(0)) + 1).cast("int"), size.cast("int"))


def slice_of_bytes(seq, start, end) -> Column:
    """``slice_between`` of a sequence of ASCII: what lies before the slice is not gone through."""
    return slice_between(_col(seq).cast("binary"), start, end).cast("string")


def positions(n) -> Column:
    """1 .. n; empty for n < 1."""
    n = _col(n) if not isinstance(n, int) else F.lit(n)
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def common_prefix_length(a, b) -> Column:
    def length(pair: Column) -> Column:
        n = F.coalesce(F.least(F.length(pair["a"]), F.length(pair["b"])), F.lit(0))
        # halving: as many steps as n has binary digits
        longer = lambda m, s: F.when((m + s <= n) & (F.left(pair["a"], m + s) == F.left(pair["b"], m + s)), m + s).otherwise(m)
        steps = F.transform(F.sequence(F.lit(0), F.length(F.bin(n)) - 1), lambda i: F.call_function("shiftleft", F.lit(1), F.length(F.bin(n)) - 1 - i))
        return F.when(F.left(pair["a"], n) == F.left(pair["b"], n), n).otherwise(F.aggregate(steps, F.lit(0), longer))

    a, b = _col(a), _col(b)
    # most differ within a few bases, which needs no lambda
    near = F.when(F.left(a, F.lit(1)) != F.left(b, F.lit(1)), 0)
    for n in range(2, NEAR + 1):
        near = near.when(F.left(a, F.lit(n)) != F.left(b, F.lit(n)), n - 1)
    return near.otherwise(let(F.struct(a.alias("a"), b.alias("b")), length))


def common_suffix_length(a, b) -> Column:
    return common_prefix_length(F.reverse(_col(a)), F.reverse(_col(b)))


def tandem_prefix(unit, flank) -> Column:
    """How far ``flank`` goes on as copies of ``unit``, the last one in part; 0 for an empty unit."""
    unit, flank = _col(unit), _col(flank)
    copies = F.floor(F.length(flank) / F.greatest(F.length(unit), F.lit(1))).cast("int") + 2
    return F.when((F.length(unit) == 0) | (F.left(unit, F.lit(1)) != F.left(flank, F.lit(1))), 0).otherwise(common_prefix_length(F.repeat(unit, copies), flank))


def tandem_suffix(unit, flank) -> Column:
    return tandem_prefix(F.reverse(_col(unit)), F.reverse(_col(flank)))


def tiles(seq, size: int, overlap: int) -> Column:
    """array<struct(at, bases)>: pieces of ``size`` bases, each with ``overlap`` bases of the next.

    The pieces are cut in one pass, so long sequences cost no more than their length.
    """

    def cut(pieces: Column) -> Column:
        after = lambda i: F.coalesce(F.left(F.get(pieces, i + 1), F.lit(overlap)), F.lit(""))
        return F.transform(pieces, lambda p, i: F.struct((i.cast("long") * size).alias("at"), F.concat(p, after(i)).alias("bases")))

    return let(F.regexp_extract_all(_col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), cut)


def kmers(seq, k: int, stranded: bool = True) -> Column:
    """All windows of k bases, in order; with the reverse complement's after them if not stranded."""
    seq = _col(seq)
    forward = F.transform(positions(F.length(seq) - (k - 1)), lambda i: F.substring(seq, i, F.lit(k)))
    return forward if stranded else F.concat(forward, F.transform(forward, lambda x: reverse_complement(x)))


def kmer_hash(kmer) -> Column:
    """md5 of a k-mer, as hex."""
    return F.md5(_col(kmer))


def window_around(seq, part, size: int, draw) -> Column:
    """A window of ``size`` bases that holds the first ``part``; ``draw`` (0 to 1) picks it.  Null where it isn't there or doesn't fit."""
    at = F.instr(_col(seq), _col(part))
    low = F.greatest(at + F.length(_col(part)) - size, F.lit(1))
    high = F.least(at, F.length(_col(seq)) - size + 1)
    start = low + F.floor(_col(draw) * (high - low + 1)).cast("int")
    return F.when((at > 0) & (low <= high), F.substring(_col(seq), F.least(start, high), F.lit(size)))


def canonical(kmer) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(_col(kmer), reverse_complement(kmer))


def canonical_kmers(seq, k: int) -> Column:
    """The canonical k-mer of every window; the sequence is turned round once."""
    seq = _col(seq)
    pair = F.struct(seq.alias("f"), reverse_complement(seq).alias("r"), F.length(seq).alias("n"))

    def windows(p: Column) -> Column:
        turned = lambda i: F.substring(p["r"], p["n"] - i - (k - 2), F.lit(k))
        return F.transform(positions(p["n"] - (k - 1)), lambda i: F.least(F.substring(p["f"], i, F.lit(k)), turned(i)))

    return let(pair, windows)


def shares_kmer(mutant, wild, k: int) -> Column:
    """Whether a k-mer of ``mutant`` is in ``wild``; the last k-mer isn't looked at, by definition here.

    A mutant of k bases or fewer is looked for as a whole.
    """
    mutant, wild = _col(mutant), _col(wild)
    some = F.exists(positions(F.length(mutant) - k), lambda i: F.contains(wild, F.substring(mutant, i, F.lit(k))))
    # the bases that all of these k-mers have (none in a mutant of 2k or more) are looked for first
    common = F.substring(mutant, F.length(mutant) - k, F.greatest(2 * k + 1 - F.length(mutant), F.lit(0)))
    return F.when(F.length(mutant) <= k, F.contains(wild, mutant)).when(~F.contains(wild, common), False).otherwise(some)


def contained(seq, other, stranded: bool = False) -> Column:
    """Whether ``seq`` is in ``other`` (or in its reverse complement)."""
    hit = F.contains(_col(other), _col(seq))
    return hit if stranded else hit | F.contains(reverse_complement(other), _col(seq))


def longest_homopolymer(seq) -> Column:
    """struct(length, runs): the longest runs of one base (upper case), distinct and sorted.

    (0, null) without any run; null for null.
    """
    runs = F.regexp_extract_all(_col(seq), F.lit("(A+|C+|G+|T+)"), F.lit(1))

    # runs, and then their greatest length, are worked out once and not for every run
    def found(runs: Column) -> Column:
        length = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
        return let(F.struct(runs.alias("runs"), length.alias("length")), longest)

    def longest(x: Column) -> Column:
        some = F.filter(x["runs"], lambda r: F.length(r) == x["length"])
        return F.struct(x["length"].alias("length"), F.when(x["length"] > 0, F.array_sort(F.array_distinct(some))).alias("runs"))

    return F.when(_col(seq).isNotNull(), let(runs, found))


def triplet_stats(seq) -> Column:
    """struct(distinct, total, complexity) of the 3-mers; null for null."""
    threes = kmers(seq, 3)
    total, distinct = F.size(threes), F.size(F.array_distinct(threes))
    ratio = F.when(total > 0, distinct / total).otherwise(F.lit(0.0))
    return F.when(_col(seq).isNotNull(), F.struct(distinct.alias("distinct"), total.alias("total"), ratio.alias("complexity")))


def codon_table() -> dict[str, str]:
    order = [a + b + c for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES]
    return dict(zip(order, AMINO_ACIDS, strict=True))


def translate_codons(seq, start: int = 0, end: int | None = None) -> Column:
    """Amino acids of the codons from ``start``; unknown and short ones are X, and X goes at both ends."""
    seq = _col(seq)
    stop = F.length(seq) if end is None else F.lit(end)
    part = F.upper(slice_between(seq, F.lit(start), stop))
    table = F.create_map(*(F.lit(x) for pair in codon_table().items() for x in pair))
    n = F.ceil(F.length(part) / 3)
    amino = F.transform(positions(n), lambda i: F.coalesce(F.try_element_at(table, F.substring(part, i * 3 - 2, F.lit(3))), F.lit("X")))
    return F.regexp_replace(F.array_join(amino, ""), "^X+|X+$", "")


def find_position(seq, part) -> Column:
    """0-based place of ``part``; null if it isn't there."""
    found = F.instr(_col(seq), _col(part))
    return F.when(found > 0, found - 1)


def leading_ns(seq) -> Column:
    return F.length(_col(seq)) - F.length(F.regexp_replace(_col(seq), "^N+", ""))


def ambiguous_bases(seq) -> Column:
    some = F.contains(_col(seq), F.lit("N")) | F.contains(_col(seq), F.lit("n"))
    return F.when(~some, 0).otherwise(F.regexp_count(_col(seq), F.lit("[Nn]")))


def cigar_end(pos, cigar) -> Column:
    """Last reference position of an alignment: M, D, N, = and X consume the reference."""
    parts = F.regexp_extract_all(_col(cigar), F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return _col(pos) + F.aggregate(parts, F.lit(0), lambda a, x: a + x.cast("int")) - 1


def join_hash(items) -> Column:
    """md5 of a list's items joined with '::'."""
    return F.md5(F.array_join(_col(items), "::"))


def register_sql(spark: SparkSession) -> None:
    """The basic functions as SQL functions of the session."""
    from . import hgvs

    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN reverse(translate(s, '{BASES}', '{COMPLEMENTS}'))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION kmers(s STRING, k INT) RETURNS ARRAY<STRING> RETURN "
        "CASE WHEN length(s) >= k THEN transform(sequence(1, length(s) - k + 1), i -> substring(s, i, k)) ELSE CAST(array() AS ARRAY<STRING>) END"
    )
    for name, group in (("hgvs_positions", 1), ("hgvs_change", 2)):
        pattern = hgvs.PATTERN.replace("\\", "\\\\")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS STRING RETURN nullif(regexp_extract(v, '{pattern}', {group}), '')")
