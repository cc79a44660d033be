"""Variant-containing reference sequences (VCRS) from variants and sequences."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hgvs as H
from ..functions import sequence as S
from .fixed import fixed, in_columns, is_written, materialised
from .number import numbered

#: Bases of a tile of a long sequence, and how many of the next tile it has besides.  A window that is
#: no longer than the overlap lies in one tile.
TILE, OVERLAP = 1 << 12, 1 << 9
#: Why a variant is left out, in the order in which it is looked at.
REASONS = [
    "missing", "duplicate", "unknown_sequence", "uncertain", "ambiguous_position", "intronic", "posttranslational",
    "unparsed", "outside", "long_duplication", "wrong_wild_type_base", "insertion_too_long", "shares_wild_type_kmer",
    "too_short", "too_many_n", "empty",
]


@dataclass
class BuildOptions:
    w: int = 47
    k: int = 51
    max_ambiguous: int | None = 0
    optimize_flanks: bool = True
    remove_wild_type_kmers: bool = True
    min_seq_len: int | None = None  # k where it is not given
    required_insertion_overlap: int | str | None = None
    insertion_size_limit: int | None = None
    merge_identical: bool = True
    merge_reverse_complements: bool = True
    transcript_bounds: bool = False
    #: Whether the rows are known to name each variant of a sequence once, so that none is looked at for its duplicates.
    distinct: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.w:
            raise ValueError("w must be positive")
        if not self.w < self.k <= 2 * self.w:
            raise ValueError(f"k must be above w and at most 2w: w={self.w}, k={self.k}")


@dataclass
class Built:
    """``variants``: one row per variant that stays; ``merged``: the merged sequences; ``vcrs``: these, numbered;
    ``checked``: every input variant with its ``drop_reason`` (null: it stays)."""

    variants: DataFrame
    merged: DataFrame
    checked: DataFrame

    @cached_property
    def vcrs(self) -> DataFrame:
        return numbered(self.merged, "original_order")  # sorts and writes all rows, so only where it is asked for

    def report(self) -> DataFrame:
        return self.checked.groupBy("drop_reason").agg(F.count("*").alias("variants"))


def prepare(variants: DataFrame, seq_id_col: str, var_col: str, id_col: str | None = None) -> DataFrame:
    """Adds seq_id, variant, header and original_order; keeps all columns."""
    out = variants.withColumns({"seq_id": H.plain_seq_id(seq_id_col), "variant": F.col(var_col)})
    header = F.col(id_col) if id_col else F.concat("seq_id", F.lit(":"), "variant")
    out = out.withColumn("header", header)
    return out if "original_order" in out.columns else out.withColumn("original_order", F.monotonically_increasing_id())


def literal_inputs(spark: SparkSession, sequences: str | list[str], variants: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(variants, sequences) from texts given in place: seq1, seq2 ... with one variant each, or one for all."""
    seqs = [sequences] if isinstance(sequences, str) else list(sequences)
    names = [variants] * len(seqs) if isinstance(variants, str) else list(variants)
    names = names * len(seqs) if len(names) == 1 else names
    if len(names) != len(seqs):
        raise ValueError(f"{len(names)} variants for {len(seqs)} sequences: as many are needed, or one for all")
    ids = [f"seq{i}" for i in range(1, len(seqs) + 1)]
    rows = spark.createDataFrame(list(zip(ids, names, [f"var{i}" for i in range(1, len(ids) + 1)], strict=True)), "seq_ID string, mutation string, var_ID string")
    return rows, spark.createDataFrame(list(zip(ids, seqs, strict=True)), "seq_id string, sequence string")


def with_transcript_bounds(variants: DataFrame, gtf: DataFrame, seq_id_col: str = "seq_ID") -> DataFrame:
    """``variants`` with start_transcript_position, end_transcript_position and strand of their transcript.

    Unknown transcripts get 0, 9999999 and '.'; one that the GTF names twice is an error.
    """
    known = gtf.filter("feature = 'transcript'").select(H.without_version("transcript_id").alias("_id"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("strand").alias("_strand"))
    once = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("transcript named twice: "), F.first("_id")))).otherwise(F.first("_s"))
    known = known.groupBy("_id").agg(once.alias("_s"), F.first("_e").alias("_e"), F.first("_strand").alias("_strand"))
    out = variants.join(known, H.without_version(seq_id_col) == F.col("_id"), "left")
    values = {
        "start_transcript_position": F.coalesce("_s", F.lit(0)), "end_transcript_position": F.coalesce("_e", F.lit(9999999)), "strand": F.coalesce("_strand", F.lit(".")),
    }
    return out.withColumns(values).drop("_id", "_s", "_e", "_strand")


def without_duplications(variants: DataFrame, var_col: str = "mutation") -> DataFrame:
    """The rows that name no duplication; rows without a name stay."""
    return variants.filter(~F.coalesce(F.contains(F.col(var_col), F.lit("dup")), F.lit(False)))


def with_genome_variant(variants: DataFrame, var_col: str = "mutation_genome") -> DataFrame:
    """The rows that have a variant on the genome."""
    return variants.filter(F.coalesce(F.col(var_col), F.lit("")).rlike(r"^g\.|^[^:]+:g\."))


def _filled(variants: DataFrame) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in variants.columns), F.lit(0))


def _ranked(variants: DataFrame, *group: str) -> DataFrame:
    best = Window.partitionBy(*group).orderBy(F.desc("_filled"), "original_order")
    return variants.withColumn("_rank", F.row_number().over(best)).drop("_filled")


def keep_fullest(variants: DataFrame) -> DataFrame:
    """Of rows with the same sequence and variant, the one with the fewest nulls; then the first."""
    return _ranked(variants.withColumn("_filled", _filled(variants)), "seq_id", "variant")


def _tiles(sequences: DataFrame, *more: Column) -> DataFrame:
    tiles = sequences.select("seq_id", *more, F.inline(S.tiles("sequence", TILE, OVERLAP)))
    plain = F.octet_length("bases") == F.length("bases")
    return tiles.withColumns({"_tile": _tile_of("at"), "_bases": F.col("bases"), "_plain": plain}).drop("at", "bases")


def _tile_of(place) -> Column:
    return F.floor(F.greatest(place, F.lit(0)) / TILE)


def _cut(low: str, high: str) -> Column:
    start, end = (F.col(c) - F.col("_tile") * TILE for c in (low, high))
    return F.when(F.col("_plain"), S.slice_of_bytes("_bases", start, end)).otherwise(S.slice_between("_bases", start, end))


def windows(rows: DataFrame, sequences: DataFrame, low: str, high: str, name: str, longest: int | None = None) -> DataFrame:
    """``rows`` with the bases [low, high) of their sequence as column ``name``; ``longest`` is the most bases that
    a window has, where that is known.

    Sequences are dealt in overlapping tiles, so no row ever carries a whole chromosome: a window
    that is no longer than the overlap lies in the tile that begins at or before it.  Longer windows
    (of long deletions) are put together from the tiles that they touch.
    """
    tiles, number, cut = _tiles(sequences), _tile_of, _cut(low, high)
    short = (F.col(high) - F.col(low)) <= OVERLAP
    near = rows.filter(short).withColumn("_tile", number(F.col(low))).join(tiles, ["seq_id", "_tile"], "left")
    near = near.withColumn(name, cut).drop("_tile", "_bases", "_plain")
    if longest is not None and longest <= OVERLAP:
        return near
    far = rows.filter(~short)
    touched = far.select("seq_id", low, high).distinct().select("*", F.explode(F.sequence(number(F.col(low)), number(F.col(high) - 1))).alias("_tile"))
    parts = touched.join(tiles.withColumn("_bases", F.left("_bases", F.lit(TILE))), ["seq_id", "_tile"])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_tile", cut.alias("_part")))), lambda p: p["_part"]), "")
    far = far.join(parts.groupBy("seq_id", low, high).agg(whole.alias(name)), ["seq_id", low, high], "left")
    return near.unionByName(far)


def _first_reason(*cases: tuple[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for reason, condition in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), reason).otherwise(out)
    return out


def build(variants: DataFrame, sequences: DataFrame, options: BuildOptions | None = None, *, seq_id_col="seq_ID", var_col="mutation", id_col=None) -> Built:
    """``sequences``: seq_id, sequence.  Further columns of ``variants`` are kept.

    Variants are dealt once, by the tile of their sequence at which their window begins: there equal ones meet, and
    there the tile is, with the length of its sequence.  The rows with their windows are written once, as columns.
    What no tile holds (unknown sequences, names without positions, long windows) is looked up from that table by
    itself; everything else is an expression over one row.
    """
    o = options or BuildOptions()
    w, k = o.w, o.k
    rows = prepare(variants, seq_id_col, var_col, id_col)
    given = rows.columns
    rows = rows.withColumn("_filled", F.lit(0) if o.distinct else _filled(rows))
    rows = rows if id_col else rows.drop("header")  # it follows from seq_id and variant
    sequences = sequences.select("seq_id", "sequence") if is_written(sequences) else materialised(sequences.select("seq_id", "sequence"))
    length = F.length("sequence").cast("long").alias("sequence_length")
    v = F.col("variant")
    # a name is searched once for its positions and once for its change
    rows = fixed(rows, {"nucleotide_positions": F.regexp_extract(v, H.PATTERN, 1), "actual_variant": F.regexp_extract(v, H.PATTERN, 2)})
    rows = fixed(rows, {c: F.when(F.col(c) != "", F.col(c)) for c in ("nucleotide_positions", "actual_variant")})
    rows = fixed(rows, {"named_start": H.positions_start("nucleotide_positions") - 1, "named_end": H.positions_end("nucleotide_positions") - 1})
    kind = F.col("variant_type")
    insertion, duplication = kind == "insertion", kind == "duplication"

    def shaped(rows: DataFrame) -> DataFrame:
        """``rows`` with what follows from their name, which is worked out again where it is needed and does not travel."""
        rows = fixed(rows, {"variant_type": H.change_type("actual_variant")})
        # an insertion lies between its positions; a duplication is an insertion after its bases
        rows = fixed(rows, {
            "wild_start": F.when(insertion, F.col("named_start") + 1).otherwise(F.col("named_start")),
            "end": F.when(insertion, F.col("named_end") - 1).otherwise(F.col("named_end")),
        })
        return fixed(rows, {"start": F.when(duplication, F.col("end") + 1).otherwise(F.col("wild_start"))})

    derived = ("variant_type", "wild_start", "end", "start")
    rows = shaped(rows)
    first = F.least(F.greatest(F.col("start") - w, F.lit(0)), "wild_start")
    # names without positions are dealt to numbers that no tile has
    spread = F.when(F.col("named_start").isNull() | F.col("named_end").isNull(), -1 - F.pmod(F.xxhash64("variant"), F.lit(1 << 20)))
    rows = rows.withColumn("_tile", F.coalesce(spread, _tile_of(first))).drop(*derived).repartition("seq_id", "_tile")
    rows = rows.withColumn("_rank", F.lit(1)).drop("_filled") if o.distinct else _ranked(rows, "seq_id", "_tile", "variant")
    rows = rows.join(_tiles(sequences, length).hint("shuffle_hash"), ["seq_id", "_tile"], "left")  # a task holds the tiles of its range

    def placed(rows: DataFrame) -> DataFrame:
        """``rows`` with the place of their window, by the length of their sequence."""
        size = F.col("sequence_length")
        low, high = F.greatest(F.col("start") - w, F.lit(0)), F.least(F.col("end") + w, size) + 1
        if o.transcript_bounds:
            low = F.greatest(low, F.coalesce(F.col("start_transcript_position") - 1, F.lit(0)))
            high = F.least(F.col("end") + w, size, F.coalesce(F.col("end_transcript_position"), size)) + 1
        rows = fixed(shaped(rows), {"flank_low": low, "flank_high": high})
        return fixed(rows, {"_low": F.least("flank_low", "wild_start"), "_high": F.greatest("flank_high", F.col("end") + 1)})

    def judged(rows: DataFrame) -> DataFrame:
        """``rows`` with their reason so far."""
        size = F.col("sequence_length")
        has = lambda *marks: reduce(Column.__or__, (F.contains(v, F.lit(m)) for m in marks))
        early = _first_reason(
            ("missing", F.col("seq_id").isNull() | v.isNull()),
            ("duplicate", F.col("_rank") > 1),
            ("unknown_sequence", size.isNull()),
            ("uncertain", has("?")),
            ("ambiguous_position", has("(", ")")),
            ("intronic", has("+", "-")),
            ("posttranslational", has("*")),
            ("unparsed", F.col("nucleotide_positions").isNull() | F.col("actual_variant").isNull() | F.col("named_start").isNull() | F.col("named_end").isNull()),
            # a position one beyond the end passes here, and has no base
            ("outside", (F.col("named_start") > size) | (F.col("named_end") > size)),
        )
        return fixed(rows, {"drop_reason": early})

    places = (*derived, "flank_low", "flank_high", "_low", "_high")
    whole = F.col("_bases").isNotNull() & (F.col("_high") <= (F.col("_tile") + 1) * TILE + OVERLAP)
    rows = judged(placed(rows))
    rows = rows.withColumns({"_held": F.coalesce(whole, F.lit(False)), "_window": F.when(whole, _cut("_low", "_high"))}).drop("_bases", "_plain", "_tile", *places)
    rows = in_columns(rows)  # read for what a tile holds, for the rest, and for what is left out
    rows = rows if id_col else rows.withColumn("header", F.concat("seq_id", F.lit(":"), "variant"))
    rest = rows.filter("NOT _held").drop("sequence_length", "drop_reason", "_window")
    rest = judged(rest.join(sequences.select("seq_id", length), "seq_id", "left"))
    far = windows(placed(rest.filter("drop_reason IS NULL")), sequences, "_low", "_high", "_window")
    live = placed(rows.filter("_held AND drop_reason IS NULL"))
    live = live.unionByName(far.select(*live.columns)).select(*given, *(c for c in live.columns if c not in (*given, "_held", "_rank")))
    dropped = rows.filter("_held AND drop_reason IS NOT NULL").select("header", "drop_reason").unionByName(rest.filter("drop_reason IS NOT NULL").select("header", "drop_reason"))

    part = lambda a, b: S.slice_between("_window", F.greatest(a, F.col("_low")) - F.col("_low"), b - F.col("_low"))
    live = fixed(live, 
        {
            "left_flank": part(F.col("flank_low"), F.col("start")),
            "right_flank": part(F.col("end") + 1, F.col("flank_high")),
            "wild": F.when(insertion, "").otherwise(part(F.col("wild_start"), F.col("end") + 1)),
        }
    ).drop("_window", "_low", "_high")
    change = F.col("actual_variant")
    mutant = (
        F.when(kind == "substitution", F.substring(change, -1, 1))
        .when(kind == "deletion", "")
        .when(kind == "delins", F.regexp_extract(change, "delins([A-Z]+)", 1))
        .when(insertion, F.regexp_extract(change, "ins([A-Z]+)", 1))
        .when(duplication, F.col("wild"))
        .when(kind == "inversion", S.lenient_reverse_complement("wild"))
    )
    stated = F.when(kind == "substitution", F.substring(change, 1, 1))
    live = fixed(live, {"mutant": mutant, "_wrong": (stated != F.col("wild")) & (F.col("wild") != "")})
    live = fixed(live, {"wild": F.when(duplication, "").otherwise(F.col("wild"))})
    inserted = F.when(kind.isin("insertion", "delins", "duplication", "inversion"), F.length("mutant"))
    live = fixed(live, {"inserted_length": inserted})
    limit = o.insertion_size_limit
    need = o.required_insertion_overlap
    limits = F.lit(False) if limit is None else F.col("inserted_length") > limit
    if o.optimize_flanks and need and need != 1:
        need = float("inf") if need == "all" else need
        if need >= 2 * w:
            limits = limits | (F.col("inserted_length") >= 2 * w)
    live = fixed(live, {
        "drop_reason": _first_reason(
            ("unparsed", kind == "unknown"),
            ("long_duplication", duplication & (F.col("named_end") - F.col("named_start") >= k) & F.lit(o.remove_wild_type_kmers)),
            ("wrong_wild_type_base", F.col("_wrong")),
            ("insertion_too_long", limits),
        ),
    }).drop("_wrong")
    if o.optimize_flanks:
        probe = F.when(kind == "deletion", F.col("wild")).otherwise(F.col("mutant"))
        through = kind.isin("delins", "inversion")
        right = F.when(through, F.concat("wild", "right_flank")).otherwise(F.col("right_flank"))
        left = F.when(through, F.concat("left_flank", "wild")).otherwise(F.col("left_flank"))
        other = kind != "substitution"
        # what is compared, and turned round for the left side, is written first, so that no comparison works it out again
        live = fixed(live, {"_probe": F.when(other, probe), "_right": F.when(other, right), "_left": F.when(other, F.reverse(left))})
        live = fixed(live, {"_turned": F.reverse("_probe")})
        live = fixed(live, {"_begins": F.when(other, S.tandem_prefix("_probe", "_right")), "_ends": F.when(other, S.tandem_prefix("_turned", "_left"))})
        live = live.drop("_probe", "_right", "_left", "_turned")
        begins, ends = F.col("_begins"), F.col("_ends")
        if need and need != 1:
            least = F.col("inserted_length") if need == float("inf") else F.least(F.col("inserted_length"), F.lit(int(need) - 1))
            begins, ends = F.greatest(begins, least), F.greatest(ends, least)
        trim_left = F.when(other, F.greatest(begins - (w - F.length("left_flank")), F.lit(0))).otherwise(0)
        trim_right = F.when(other, F.greatest(ends - (w - F.length("right_flank")), F.lit(0))).otherwise(0)
    else:
        trim_left = trim_right = F.lit(0)
    live = fixed(live, {"trim_left": trim_left, "trim_right": trim_right}).drop("_begins", "_ends")
    head = S.slice_between("left_flank", "trim_left", F.length("left_flank"))
    tail = S.slice_between("right_flank", F.lit(0), F.length("right_flank") - F.col("trim_right"))
    live = fixed(live, {"wt_sequence": F.concat(head, "wild", tail), "vcrs_sequence": F.concat(head, "mutant", tail)})
    least_length = k if o.min_seq_len is None else o.min_seq_len
    late = _first_reason(
        ("shares_wild_type_kmer", S.shares_kmer("vcrs_sequence", "wt_sequence", k) & F.lit(o.remove_wild_type_kmers)),
        ("too_short", F.length("vcrs_sequence") < least_length),
        ("too_many_n", (S.ambiguous_bases("vcrs_sequence") > o.max_ambiguous) if o.max_ambiguous is not None else F.lit(False)),
        ("empty", F.coalesce(F.col("vcrs_sequence"), F.lit("")) == ""),
    )
    live = fixed(live, {"drop_reason": F.coalesce("drop_reason", late)})
    checked = dropped.unionByName(live.select("header", "drop_reason"))
    staying = live.filter("drop_reason IS NULL").drop("drop_reason", "trim_left", "trim_right", "flank_low", "flank_high", "wild_start")
    vcrs = merge_identical(staying, o.merge_reverse_complements) if o.merge_identical else staying.select(F.col("header").alias("vcrs_header"), "vcrs_sequence", "original_order")
    return Built(staying, vcrs, checked)


def merge_identical(variants: DataFrame, reverse_complements: bool = True, keep_wild_types: bool = False) -> DataFrame:
    """One row per distinct sequence (or pair with its reverse complement): vcrs_header (headers
    joined with ';' in order), vcrs_sequence (of the first header), original_order (the least), and
    with ``keep_wild_types`` wt_sequences, in the order of the headers."""
    seq = F.col("vcrs_sequence")
    # one that begins with less than the other strand does is the smaller, and is not turned round
    least = F.when(F.left(seq, F.lit(1)) < S.reverse_complement(F.right(seq, F.lit(1))), seq).otherwise(F.least(seq, S.reverse_complement(seq)))
    key = least if reverse_complements else seq
    more = ["wt_sequence"] if keep_wild_types else []
    rows = fixed(variants.select("header", "original_order", "vcrs_sequence", *more), {"_key": key})
    # of a sequence and its key one travels; rows are sorted by a number before any text
    row = F.struct(F.col("header").isNull().alias("nameless"), "header", (F.col("_key") != seq).alias("turned"), *more)
    merged = rows.groupBy(F.xxhash64("_key").alias("_hash"), "_key").agg(
        F.array_sort(F.collect_list(row)).alias("_rows"),
        F.min("original_order").alias("original_order"),
    )
    first = F.get("_rows", F.lit(0))
    own = F.when(first["turned"], S.reverse_complement("_key")).otherwise(F.col("_key"))
    return merged.select(
        F.array_join("_rows.header", ";").alias("vcrs_header"),
        F.when(first["header"].isNotNull(), own).alias("vcrs_sequence"),
        "original_order",
        *([F.col("_rows.wt_sequence").alias("wt_sequences")] if keep_wild_types else []),
    )
