"""Further queries over the carriers: dirty variants, the other filters, assigned reads and headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hgvs as H
from ..functions import quality as Q
from ..functions import sequence as S
from ..operators import assigned as A
from ..operators import build as B
from ..operators import counts as C
from ..operators import evaluate as E
from ..operators import filters as FL
from ..operators import info as I
from ..operators import kmers as K
from ..operators import number as N
from ..operators import ranges as R
from . import carriers as T
from .queries import _LINES, _READS, _TARGETS, _bus, _lines, _reads, _text, query

# ---- functions


@query("""SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS lenient, translate(seq, 'ACGT', 'TGCA') AS turned, contains(seq, 'GATTACA') OR contains(seq, 'TGTAATC') AS has_word,
      instr(seq, 'ACG') AS at, length(seq) - length(ltrim(seq, 'A')) AS leading_as, md5(seq) AS hashed FROM dna""", "dna")
def sequence_searches(spark, d):
    t = T.dna(spark, d)
    found = F.coalesce(S.find_position("seq", F.lit("ACG")) + 1, F.lit(0))
    return t.select(
        "doc_id", S.lenient_reverse_complement("seq").alias("lenient"), S.complement("seq").alias("turned"), S.contained(F.lit("GATTACA"), "seq").alias("has_word"),
        found.cast("long").alias("at"), S.leading_ns(F.translate("seq", "A", "N")).cast("long").alias("leading_as"), F.md5("seq").alias("hashed"),
    )


_CIGAR = "'5M' || (l_linenumber) || 'I' || (l_orderkey % 50 + 1) || 'D3N2S' || (l_linenumber + 10) || 'M'"


@query(f"""SELECT l_orderkey, l_linenumber, {_CIGAR} AS cigar, l_orderkey + 5 + (l_orderkey % 50 + 1) + 3 + l_linenumber + 10 - 1 AS ends,
      round(pow(10, -l_linenumber / 10.0), 9) AS error, 'ENST' || l_orderkey AS bare, l_linenumber::VARCHAR AS plain FROM lineitem""")
def small_helpers(spark, d):
    n, o = F.col("l_linenumber").cast("string"), F.col("l_orderkey")
    cigar = F.concat(F.lit("5M"), n, F.lit("I"), (o % 50 + 1).cast("string"), F.lit("D3N2S"), (F.col("l_linenumber") + 10).cast("string"), F.lit("M"))
    t = T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cigar.alias("cigar"))
    return t.select(
        "*", S.cigar_end("l_orderkey", "cigar").cast("long").alias("ends"), F.round(Q.error_rate("l_linenumber"), 9).alias("error"),
        H.without_version(F.concat(F.lit("ENST"), o.cast("string"), F.lit("."), n)).alias("bare"), H.plain_seq_id(F.concat(n, F.lit(".0"))).alias("plain"),
    )


@query(r"""+ t AS (SELECT 'ENST' || doc_id || ':' || variant AS strict, seq_id || ':' || variant AS header, variant, doc_id FROM variants)
    SELECT header, true AS is_strict, false AS is_strict_too, true AS is_general, CASE WHEN doc_id % 2 = 0 THEN 'transcriptome' ELSE 'genome' END AS origin,
      CASE WHEN contains(variant, '>') THEN 'substitution' WHEN contains(variant, 'delins') THEN 'delins' WHEN contains(variant, 'del') THEN 'deletion'
        WHEN contains(variant, 'ins') THEN 'insertion' WHEN contains(variant, 'dup') THEN 'duplication' ELSE 'inversion' END AS one_kind, 'mixed' AS two_kinds FROM t""", "variants")
def header_checks(spark, d):
    v = T.variants(spark, d).withColumn("header", F.concat("seq_id", F.lit(":"), "variant"))
    other = F.when(H.variant_type("variant") == "deletion", "S:c.1A>C").otherwise("S:c.1del")
    own = F.when(F.col("doc_id") % 2 == 0, F.col("variant")).otherwise(F.regexp_replace("variant", "^c", "g"))
    return v.select(
        "header", H.has_strict_header(F.concat(F.lit("ENST"), F.col("doc_id").cast("string"), F.lit(":"), "variant")).alias("is_strict"),
        H.has_strict_header(F.concat_ws(";", "header", "header")).alias("is_strict_too"), H.has_header("header").alias("is_general"), H.variant_source(own).alias("origin"),
        H.header_type(F.concat_ws(";", "header", "header")).alias("one_kind"), H.header_type(F.concat_ws(";", "header", other)).alias("two_kinds"),
    )


# ---- building from variants with all kinds of faults

_DIRTY = """raw0 AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, d.seq_id, length(d.seq) AS len, d.seq FROM lineitem l JOIN dna d ON d.doc_id = l.l_partkey % (SELECT count(*) FROM documents)),
    dirty AS (SELECT ok, ln, seq, pk, ln = 1 AND pk % 50 > len AS beyond, CASE WHEN ok % 11 = 0 THEN NULL WHEN ok % 13 = 0 THEN 'nowhere' ELSE seq_id END AS sid, CASE ln WHEN 1 THEN 'c.' || (pk % 50 + 1) || 'A>C' WHEN 2 THEN 'c.?_' || pk || 'del'
        WHEN 3 THEN 'c.(' || pk || '_' || (pk + 2) || ')del' WHEN 4 THEN 'c.' || pk || '+' || ln || 'del' WHEN 5 THEN 'c.*' || pk || 'del' WHEN 6 THEN 'p.' || pk
        ELSE 'c.' || (1000000 + pk) || '_' || (1000001 + pk) || 'dup' END AS v FROM raw0)"""


def _dirty(spark, d) -> DataFrame:
    n = T.read(spark, d, "documents").agg(F.count("*").alias("_n"))
    joined = T.read(spark, d, "lineitem").crossJoin(F.broadcast(n)).join(T.dna(spark, d), F.col("l_partkey") % F.col("_n") == F.col("doc_id"))  # one row
    ok, ln, pk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey").cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    shift = lambda n: (F.col("l_partkey") + n).cast("string")
    name = (
        F.when(ln == 1, text("c.", (F.col("l_partkey") % 50 + 1).cast("string"), "A>C")).when(ln == 2, text("c.?_", pk, "del"))
        .when(ln == 3, text("c.(", pk, "_", shift(2), ")del")).when(ln == 4, text("c.", pk, "+", ln.cast("string"), "del"))
        .when(ln == 5, text("c.*", pk, "del")).when(ln == 6, text("p.", pk)).otherwise(text("c.", shift(1000000), "_", shift(1000001), "dup"))
    )
    where = F.when(ok % 11 == 0, None).when(ok % 13 == 0, "nowhere").otherwise(F.col("seq_id"))
    return joined.select(where.alias("seq_id"), name.alias("variant"))


_LEFT, _RIGHT = "substr(seq, greatest(p - 20, 0) + 1, p - greatest(p - 20, 0))", "substr(seq, p + 2, 20)"


@query(f"""+ {_DIRTY}, r AS (SELECT *, pk % 50 AS p, row_number() OVER (PARTITION BY sid, v ORDER BY ok, ln) AS rn FROM dirty),
    s AS (SELECT *, substr(seq, p + 1, 1) AS base, {_LEFT} || 'C' || {_RIGHT} AS mutant, {_LEFT} || substr(seq, p + 1, 1) || {_RIGHT} AS wild FROM r),
    q AS (SELECT CASE WHEN sid IS NULL THEN 'missing' WHEN rn > 1 THEN 'duplicate' WHEN sid = 'nowhere' THEN 'unknown_sequence' WHEN contains(v, '?') THEN 'uncertain'
      WHEN contains(v, '(') THEN 'ambiguous_position' WHEN contains(v, '+') THEN 'intronic' WHEN contains(v, '*') THEN 'posttranslational' WHEN v LIKE 'p.%' THEN 'unparsed'
      WHEN v LIKE '%dup' OR beyond THEN 'outside' WHEN base NOT IN ('', 'A') THEN 'wrong_wild_type_base'
      WHEN CASE WHEN length(mutant) <= 25 THEN contains(wild, mutant) ELSE len([i for i in range(1, length(mutant) - 24) if contains(wild, substr(mutant, i, 25))]) > 0 END THEN 'shares_wild_type_kmer'
      WHEN length(mutant) < 25 THEN 'too_short' END AS reason FROM s)
    SELECT coalesce(reason, 'none') AS reason, count(*) AS variants FROM q GROUP BY 1""", "dna")
def build_reasons(spark, d):
    built = B.build(_dirty(spark, d), T.sequences(spark, d), B.BuildOptions(w=20, k=25), seq_id_col="seq_id", var_col="variant")
    return built.report().select(F.coalesce("drop_reason", F.lit("none")).alias("reason"), "variants")


@query("""+ t AS (SELECT seq_id, 'c.' || pos || CASE ln % 4 WHEN 0 THEN substr(seq, pos, 1) ELSE 'N' END || '>' || 'A' AS v, substr(seq, pos, 1) AS base, ln FROM raw),
    u AS (SELECT DISTINCT seq_id, v, base, ln % 4 = 0 AS right_base FROM t) SELECT seq_id || ':' || v AS header, NOT right_base AS wrong FROM u""", "raw")
def wild_type_bases(spark, d):
    base = F.substring("seq", F.col("pos").cast("int"), F.lit(1))
    named = F.when(F.col("ln") % 4 == 0, base).otherwise("N")
    v = T.raw(spark, d).select("seq_id", F.concat(F.lit("c."), F.col("pos").cast("string"), named, F.lit(">A")).alias("variant")).distinct()
    checked = B.build(v, T.sequences(spark, d), B.BuildOptions(w=20, k=25), seq_id_col="seq_id", var_col="variant").checked
    return checked.select("header", (F.coalesce("drop_reason", F.lit("")) == "wrong_wild_type_base").alias("wrong"))


@query("""WITH t AS (SELECT l_orderkey % 40 AS sid, l_linenumber AS v, nullif(l_quantity, 7.0) AS a, nullif(l_suppkey, 3) AS b, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS original_order FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY sid, v ORDER BY (a IS NULL)::INT + (b IS NULL)::INT, original_order) AS rn FROM t) SELECT sid, v, a, b, original_order FROM r WHERE rn = 1""")
def fullest_rows(spark, d):
    t = T.read(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 40).alias("seq_id"), F.col("l_linenumber").alias("variant"), F.nullif("l_quantity", F.lit(7.0)).alias("a"), F.nullif("l_suppkey", F.lit(3)).alias("b"),
        F.expr("((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey").alias("original_order"),
    )
    return B.keep_fullest(t).filter("_rank = 1").select(F.col("seq_id").alias("sid"), F.col("variant").alias("v"), "a", "b", "original_order")


@query("""SELECT o_orderkey, 'vcrs_' || lpad(row_number() OVER (ORDER BY o_totalprice, o_orderkey)::VARCHAR, length((SELECT count(*) FROM orders)::VARCHAR)::INT, '0') AS vcrs_id FROM orders""")
def numbered_rows(spark, d):
    return N.numbered(T.read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "vcrs_id")


# ---- the other filters


@query(f"WITH {_LINES} SELECT * FROM t WHERE (q >= 5 OR q IS NULL) AND (p < 60000 OR p IS NULL)")
def filter_bounds(spark, d):
    return FL.apply_filters(_lines(spark, d), ["q:greater_or_equal=5", "p:less_than=60000"])


@query(f"WITH {_LINES} SELECT * FROM t WHERE q IS NULL UNION ALL SELECT * FROM t WHERE b UNION ALL SELECT * FROM t WHERE NOT b")
def filter_nulls_and_flags(spark, d):
    t = _lines(spark, d)
    return FL.apply_filters(t, ["q:is_null"]).unionByName(FL.apply_filters(t, ["b:is_true"])).unionByName(FL.apply_filters(t, ["b:is_false"]))


# ---- headers and their sequences


@query("""+ t AS (SELECT seq_id, pos, seq_id || ':' || variant AS h FROM variants), g AS (SELECT seq_id, pos // 3 AS p, string_agg(h, ';' ORDER BY h) AS vcrs_header, list(h ORDER BY h) AS names FROM t GROUP BY ALL)
    SELECT vcrs_header, array_to_string(names, ',') AS names, len(names) AS n FROM g""", "variants")
def headers_collapsed(spark, d):
    v = T.variants(spark, d).withColumn("h", F.concat("seq_id", F.lit(":"), "variant"))
    merged = v.groupBy("seq_id", F.floor(F.col("pos") / 3).alias("p")).agg(F.array_join(F.array_sort(F.collect_list("h")), ";").alias("vcrs_header"))
    back = I.collapse(I.explode_headers(merged.select("vcrs_header")), ["vcrs_header_individual"])
    return back.select("vcrs_header", F.array_join("vcrs_header_individual", ",").alias("names"), F.size("vcrs_header_individual").cast("long").alias("n"))


@query("""+ c AS (SELECT seq_id, repeat('G', doc_id % 7 + 1) || seq AS cdna, CASE WHEN doc_id % 3 = 0 THEN 'NN' ELSE '' END || substr(seq, 3) AS cds, length(seq) AS n FROM dna WHERE seq <> ''),
    s AS (SELECT seq_id, CASE WHEN instr(cdna, ltrim(cds, 'N')) > 0 THEN instr(cdna, ltrim(cds, 'N')) - 1 - (length(cds) - length(ltrim(cds, 'N'))) END AS shift FROM c)
    SELECT v.seq_id, pos, variant, pos + shift AS start_cdna, pos + 1 + shift AS end_cdna FROM variants v LEFT JOIN s USING (seq_id)""", "variants", "dna")
def cds_positions(spark, d):
    t = T.dna(spark, d).filter("seq <> ''")
    cdna = t.select("seq_id", F.concat(F.expr("repeat('G', int(doc_id % 7 + 1))"), "seq").alias("sequence"))
    cds = t.select("seq_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "NN").otherwise(""), F.expr("substr(seq, 3)")).alias("sequence"))
    v = T.variants(spark, d).select("seq_id", "pos", "variant", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    return I.cds_to_cdna(v, cdna, cds).select("seq_id", "pos", "variant", "start_cdna", "end_cdna")


@query("""+ a AS (SELECT seq_id AS header, seq AS x FROM dna), b AS (SELECT seq_id AS header, CASE WHEN doc_id % 2 = 0 THEN seq ELSE substr(seq, 2) END AS y FROM dna)
    SELECT coalesce(a.header, b.header) AS header, x = y AS same FROM a FULL JOIN b ON a.header = b.header""", "dna")
def cdna_and_genome(spark, d):
    t = T.dna(spark, d)
    a = t.select(F.col("seq_id").alias("header"), F.col("seq").alias("vcrs_sequence"))
    b = t.select(F.col("seq_id").alias("header"), F.expr("CASE WHEN doc_id % 2 = 0 THEN seq ELSE substr(seq, 2) END").alias("vcrs_sequence"))
    return I.compare_cdna_genome(a, b).select("header", F.col("cdna_and_genome_same").alias("same"))


_SEEDS = "q AS (SELECT 'Q' || doc_id AS id, seq AS s FROM dna WHERE lang = 'en')"


@query(f"""+ {_SEEDS}, k AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(s) - 19), lambda i: substr(s, i, 21))) AS k FROM q),
    r AS (SELECT seq_id, seq, unnest(range(0, length(seq) - 20)) AS p FROM dna WHERE lang <> 'en'), h AS (SELECT DISTINCT id, seq_id, p, seq FROM k JOIN r ON substr(seq, p + 1, 21) = k)
    SELECT id || '_' || p AS header, id, substr(seq, greatest(p - 23, 0) + 1, p + 44 - greatest(p - 23, 0)) AS sequence FROM h""", "dna")
def distractor_contexts(spark, d):
    t = T.dna(spark, d)
    q = t.filter("lang = 'en'").select(F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("id"), F.col("seq").alias("sequence"))
    ref = t.filter("lang <> 'en'").select("seq_id", F.col("seq").alias("sequence"))
    return K.distractors(q, ref, 21, stranded=True)


@query("""+ q AS (SELECT 'Q' || doc_id AS id, seq AS s, CASE doc_id % 3 WHEN 0 THEN substr(seq, 2) || 'C' WHEN 1 THEN 'GA' || seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) || 'T' END AS x FROM dna)
    SELECT id FROM q WHERE contains(x, s) OR contains(reverse(translate(x, 'ACGT', 'TGCA')), s)""", "dna")
def inside_own_distractor(spark, d):
    t = T.dna(spark, d).withColumn("id", F.concat(F.lit("Q"), F.col("doc_id").cast("string")))
    around = F.when(F.col("doc_id") % 3 == 0, F.concat(F.expr("substr(seq, 2)"), F.lit("C"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("GA"), "seq"))
    dlist = t.select("id", around.otherwise(F.concat(S.reverse_complement("seq"), F.lit("T"))).alias("sequence"))
    return K.substring_of_distractor(t.select("id", F.col("seq").alias("sequence")), dlist)


@query(f"""+ {_READS}, t AS (SELECT doc_id, off, 'S' || (doc_id // 2 * 2) AS header, r FROM reads), p AS (SELECT seq_id AS header, seq FROM dna),
    k AS (SELECT doc_id, off, t.header, seq, list_transform(range(1, length(r) - 19), lambda i: substr(r, i, 21)) AS ks FROM t LEFT JOIN p ON p.header = t.header)
    SELECT doc_id, off, coalesce(len(list_filter(ks, lambda x: contains(seq, x) OR contains(reverse(translate(seq, 'ACGT', 'TGCA')), x))) > 0, false) AS shares FROM k""", "dna")
def reads_in_their_targets(spark, d):
    t = T.dna(spark, d)
    reads = _reads(spark, d).withColumn("header", F.expr("'S' || (doc_id div 2 * 2)"))
    targets = t.select(F.col("seq_id").alias("header"), F.col("seq").alias("sequence"))
    return K.reads_share_kmer(reads, targets, 21).select("doc_id", "off", F.col("read_contains_reference_kmer").alias("shares"))


@query("""+ v AS (SELECT seq_id || ':' || variant AS header, 'T' || doc_id % 50 AS transcript_id, pos % 3000 AS s FROM variants),
    l AS (SELECT transcript_id, sum(CASE WHEN feature = 'five_prime_utr' THEN "end" - "start" + 1 ELSE 0 END) AS utr5, sum("end" - "start" + 1) AS n FROM exons GROUP BY 1)
    SELECT header, s FROM v LEFT JOIN l USING (transcript_id) WHERE n IS NULL OR s + 4 + utr5 >= n - 150 - 100""", "variants", "exons")
def strand_bias_reach(spark, d):
    v = T.variants(spark, d).select(
        F.concat("seq_id", F.lit(":"), "variant").alias("header"), F.concat(F.lit("T"), (F.col("doc_id") % 50).cast("string")).alias("transcript_id"),
        (F.col("pos") % 3000).alias("start"), (F.col("pos") % 3000 + 4).alias("end"),
    )
    return R.within_strand_reach(v, R.transcript_lengths(T.exons(spark, d)), end="3p", read_length=150).select("header", F.col("start").alias("s"))


# ---- assigned reads

_CODE = "100 * cast(right(t1, 1) AS INT) + 10 * cast(right(t2, 1) AS INT) + cast(right(t3, 1) AS INT)"


def _ec(spark, d) -> tuple[DataFrame, DataFrame]:
    """The events as BUS rows with an equivalence class, and the classes' transcripts."""
    ids = [F.right(F.col(c), F.lit(1)).cast("int") for c in ("t1", "t2", "t3")]
    bus = T.bus(spark, d).withColumn("ec", 100 * ids[0] + 10 * ids[1] + ids[2])
    return bus, bus.select("ec", F.array_sort(F.array_distinct(F.array(*ids))).alias("transcript_ids")).distinct()


@query(f"""+ {_TARGETS}, e AS (SELECT *, {_CODE} AS ec, list_sort(list_distinct(list_transform(targets, lambda t: CASE WHEN t = 'T4' THEN 'T4' ELSE 'G' || (cast(right(t, 1) AS INT) // 2) END))) AS genes FROM x)
    SELECT read_index, barcode, umi, ec, array_to_string(targets, ';') AS transcripts, array_to_string(genes, ';') AS genes, len(genes) = 1 AS counted, CASE WHEN len(genes) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM e""", "bus")
def bus_reads(spark, d):
    bus, ec = _ec(spark, d)
    names = spark.range(5).select(F.col("id").cast("int").alias("index"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("name"))
    t2g = spark.range(4).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("G"), F.floor(F.col("id") / 2).cast("string")).alias("label"))
    out = A.bus_reads(bus, ec, names, t2g=t2g)
    return out.select(
        "read_index", "barcode", "umi", "ec", _text("transcript_names").alias("transcripts"), _text("gene_names").alias("genes"), F.col("counted_in_count_matrix").alias("counted"),
        F.col("count_matrix_value").alias("value"),
    )


_MATES = "m AS (SELECT read_index // 2 AS r, read_index, 'B' AS barcode, CASE WHEN read_index % 5 = 0 THEN [] ELSE list_sort(list_distinct([t1, t2])) END AS g FROM bus)"


def _mates(spark, d) -> DataFrame:
    b = T.bus(spark, d)
    genes = F.when(F.col("read_index") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.array("t1", "t2"))))
    return b.select(F.lit("B").alias("barcode"), F.floor(F.col("read_index") / 2).alias("read_index"), F.col("read_index").alias("mate"), genes.alias("genome_genes"))


@query(f"""+ {_MATES}, a AS (SELECT r, count(*) AS n, count(*) FILTER (len(g) > 0) AS filled FROM m GROUP BY 1), e AS (SELECT r, unnest(g) AS g FROM m), k AS (SELECT r, g, count(*) AS c FROM e GROUP BY ALL),
    u AS (SELECT r, string_agg(g, ';' ORDER BY g) AS genes, max(c) AS common FROM k GROUP BY 1)
    SELECT read_index AS mate, r AS read_index, coalesce(genes, '') AS genes FROM m JOIN a USING (r) LEFT JOIN u USING (r) WHERE NOT (filled = n AND n > 1 AND common < n)""", "bus")
def paired_genes(spark, d):
    return A.paired_genes(_mates(spark, d), drop_different=True).select("mate", "read_index", _text("genome_genes").alias("genes"))


@query("""+ e AS (SELECT barcode, umi, read_index, unnest([t1, t2]) AS t, unnest([1, 2]) AS i, t3 FROM bus), f AS (SELECT barcode, umi, t, min((read_index, i)) AS f FROM e GROUP BY ALL),
    l AS (SELECT barcode, umi, string_agg(t, ';' ORDER BY f) AS targets, string_agg('G' || right(t, 1), ';' ORDER BY f) AS genes FROM f GROUP BY ALL),
    w AS (SELECT barcode, umi, string_agg(read_index::VARCHAR, ';' ORDER BY read_index) AS reads, list_sort(list_distinct(list(t3) FILTER (t3 <> 'T1'))) AS seen FROM bus GROUP BY ALL)
    SELECT barcode, umi, reads, targets, genes, coalesce(array_to_string(seen, ';'), '') AS seen, coalesce(len(seen), 0) > 0 AS aligned FROM w JOIN l USING (barcode, umi)""", "bus")
def molecule_targets(spark, d):
    gene = lambda c: F.concat(F.lit("G"), F.right(F.col(c), F.lit(1)))
    seen = F.when(F.col("t3") != "T1", F.array("t3")).otherwise(F.array().cast("array<string>"))
    reads = T.bus(spark, d).select("barcode", "umi", "read_index", F.array("t1", "t2").alias("targets"), F.array(gene("t1"), gene("t2")).alias("genes"), seen.alias("genome_genes"))
    out = A.molecules(reads)
    return out.select(
        "barcode", "umi", _text(F.col("read_indexes").cast("array<string>")).alias("reads"), _text("targets").alias("targets"), _text("genes").alias("genes"), _text("genome_genes").alias("seen"),
        F.col("aligned_to_genome").alias("aligned"),
    )


@query(f"""+ {_TARGETS}, c AS (SELECT len(targets) AS b, len(list_filter(targets, lambda t: t <> 'T0')) AS a FROM x)
    SELECT count(*) FILTER (b > 1 AND a = 1) AS counts_added, count(*) FILTER (b = 1 AND a = 0) AS counts_removed, count(*) FILTER (a < b AND (a = 1 OR a = 0 AND b = 1)) AS reads_changed FROM c""", "bus")
def changed_counts(spark, d):
    left = F.filter("targets", lambda t: t != "T0")
    return A.changed_counts(_bus(spark, d).select(F.size("targets").alias("before"), F.size(left).alias("after")))


@query(f"""+ {_TARGETS}, p AS (SELECT *, {_CODE} AS ec, read_index % 700 AS r FROM x), u AS (SELECT barcode, unnest(targets) AS vcrs_id FROM p), m AS (SELECT barcode, vcrs_id, count(*)::DOUBLE AS c FROM u GROUP BY ALL),
    s AS (SELECT barcode, ec, r, any_value(targets) AS targets, count(*) - 1 AS n FROM p WHERE read_index % 3 > 0 GROUP BY ALL HAVING count(*) > 1), l AS (SELECT barcode, unnest(targets) AS vcrs_id, n FROM s),
    t AS (SELECT barcode, vcrs_id, sum(n) AS n FROM l WHERE vcrs_id <> 'T2' GROUP BY ALL) SELECT m.barcode, m.vcrs_id, c - coalesce(n, 0) AS "count" FROM m LEFT JOIN t USING (barcode, vcrs_id)""", "bus")
def double_counts_removed(spark, d):
    header = F.concat(F.lit("r"), (F.col("read_index") % 700).cast("string"), F.lit(":"), F.col("read_index").cast("string"), F.lit("-9"))
    bus, _ = _ec(spark, d)
    reads = bus.withColumns({"targets": F.array_sort(F.array_distinct(F.array("t1", "t2", "t3"))), "fastq_header": header, "counted_in_count_matrix": F.col("read_index") % 3 > 0})
    matrix = reads.select("barcode", F.explode("targets").alias("vcrs_id")).groupBy("barcode", "vcrs_id").agg(F.count("*").cast("double").alias("count"))
    only = spark.range(5).filter("id <> 2").select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("vcrs_id"))
    return A.without_double_counts(matrix, reads, split_at_n=True, only=only)


@query("""+ g AS (SELECT doc_id, 'G' || (doc_id % 9) AS gene FROM dna WHERE doc_id % 4 <> 0), v AS (SELECT seq_id, doc_id, pos, seq_id || ':' || variant AS h, variant FROM variants)
    SELECT h AS header, seq_id, variant AS mutation, pos AS start_pos, coalesce(gene, seq_id) AS gene, coalesce(gene, seq_id) || '(' || seq_id || '):' || variant AS with_gene FROM v LEFT JOIN g USING (doc_id)""", "variants")
def header_information(spark, d):
    each = T.variants(spark, d).select(F.concat("seq_id", F.lit(":"), "variant").alias("vcrs_header_individual"))
    t2g = T.dna(spark, d).filter("doc_id % 4 <> 0").select(F.concat("seq_id", F.lit(".2")).alias("name"), F.expr("'G' || (doc_id % 9) || '.1'").alias("label"))
    out = A.header_information(each, t2g=t2g)
    return out.select(
        F.col("vcrs_header_individual").alias("header"), F.col("seq_ID").alias("seq_id"), "mutation", F.col("start_variant_position").alias("start_pos"), F.col("gene_id").alias("gene"),
        F.col("vcrs_header_with_gene_name").alias("with_gene"),
    )


@query("""+ e AS (SELECT 'C' || (pos % 5) || ':g.' || (pos % 2500 + 1) || 'A>C' AS h, 'C' || (pos % 5) AS s, pos % 2500 + 1 AS p FROM variants)
    SELECT h AS header, coalesce((SELECT arg_min(gene_id, ordinal) FROM exons x WHERE x.seq_id = e.s AND e.p BETWEEN x."start" AND x."end"), 'unknown') AS gene FROM (SELECT DISTINCT * FROM e) e""", "variants", "exons")
def header_information_genome(spark, d):
    where, place = F.concat(F.lit("C"), (F.col("pos") % 5).cast("string")), (F.col("pos") % 2500 + 1).cast("string")
    each = T.variants(spark, d).select(F.concat(where, F.lit(":g."), place, F.lit("A>C")).alias("vcrs_header_individual")).distinct()
    return A.header_information(each, genes=T.exons(spark, d)).select(F.col("vcrs_header_individual").alias("header"), F.col("gene_id").alias("gene"))


@query("""+ v AS (SELECT seq_id || ':' || variant AS h, seq_id, pos FROM variants) SELECT h AS header, CASE WHEN pos % 3 > 0 THEN pos END AS pos, CASE WHEN pos % 3 > 0 THEN seq_id END AS other,
      CASE WHEN pos % 2 > 0 THEN pos * 2 END AS twice FROM v""", "variants")
def variant_columns(spark, d):
    v = T.variants(spark, d).select(F.concat("seq_id", F.lit(":"), "variant").alias("vcrs_header"), F.col("seq_id").alias("name"), "pos")
    each = v.select(F.col("vcrs_header").alias("vcrs_id_individual"), F.lit("x").alias("name"))
    with_them = A.with_variants(each, v.filter("pos % 3 > 0"), columns=["name", "pos", "absent"])
    more = v.filter("pos % 2 > 0").select(F.col("vcrs_header").alias("vcrs_id_individual"), (F.col("pos") * 2).alias("twice"), F.lit(1).alias("name"))
    out = A.with_metadata(with_them, more.union(more), "vcrs_id_individual")
    return out.select(F.col("vcrs_id_individual").alias("header"), "pos", F.col("name_variant").alias("other"), "twice")


@query(f"""+ {_TARGETS} SELECT read_index, array_to_string(list_transform(targets, lambda t: CASE WHEN t = 'T4' THEN 'T4' ELSE 'H' || right(t, 1) END), ';') AS names,
      array_to_string(list_transform(targets, lambda t: CASE WHEN t = 'T4' THEN '-' ELSE 'G' || right(t, 1) END), ';') AS genes FROM x""", "bus")
def named_targets(spark, d):
    label = lambda p: F.concat(F.lit(p), F.col("id").cast("string"))
    known = spark.range(4).select(label("T").alias("vcrs_id"), label("H").alias("vcrs_header"), label("G").alias("gene_id"))
    out = A.named_targets(_bus(spark, d), known)
    genes = F.transform("genes_vcrs", lambda g: F.coalesce(g, F.lit("-")))
    return out.select("read_index", _text("vcrs_names").alias("names"), _text(genes).alias("genes"))


@query(f"""+ {_MATES} SELECT a.r AS name, array_to_string(a.g, ';') AS genes_1, array_to_string(b.g, ';') AS genes_2, len(a.g) > 0 AND len(b.g) > 0 AND NOT list_has_any(a.g, b.g) AS different
    FROM m a JOIN m b ON a.r = b.r AND a.read_index % 2 = 0 AND b.read_index % 2 = 1""", "bus")
def mates_side_by_side(spark, d):
    m = _mates(spark, d)
    header = F.concat(F.col("read_index").cast("string"), F.when(F.col("mate") % 2 == 0, "/1").otherwise("/2"))
    out = A.mates_side_by_side(m.select(header.alias("fastq_header"), F.col("genome_genes").alias("genes")))
    return out.select(F.col("name").cast("long").alias("name"), _text("genes_1").alias("genes_1"), _text("genes_2").alias("genes_2"), F.col("map_to_different_genes").alias("different"))


@query("""SELECT count(*) FILTER (doc_id % 3 = 0) AS spliced_only, count(*) FILTER (doc_id % 3 = 1) AS unspliced_only, count(*) FILTER (doc_id % 3 = 2) AS both FROM documents""")
def spliced_headers(spark, d):
    header = F.expr("CASE doc_id % 3 WHEN 0 THEN 'a;b' WHEN 1 THEN 'a_unspliced' ELSE 'a_unspliced;b' END")
    return A.spliced_headers(T.read(spark, d, "documents").select(header.alias("header")))


@query("""+ t AS (SELECT vcrs_id, sum("count") AS n FROM counts GROUP BY 1) SELECT vcrs_id FROM t WHERE n >= 500""", "counts")
def detected_variants(spark, d):
    return A.detected_variants(T.counts(spark, d), 500)


# ---- counts and comparisons


@query("""+ m AS (SELECT vcrs_id, sum("count") AS m FROM counts WHERE "count" > 25 GROUP BY 1), w AS (SELECT vcrs_id, sum("count") AS w FROM counts WHERE "count" <= 25 GROUP BY 1)
    SELECT vcrs_id, round(m / nullif(m + w, 0), 9) AS vaf FROM m LEFT JOIN w USING (vcrs_id)""", "counts")
def allele_fractions_across(spark, d):
    c = T.counts(spark, d)
    return C.allele_fractions_across(c.filter(F.col("count") > 25), c.filter(F.col("count") <= 25)).withColumn("vaf", F.round("vaf", 9))


@query("""+ b AS (SELECT vcrs_id, CASE WHEN sum("count") > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS "count" FROM counts WHERE "count" > 10 AND cast(substr(vcrs_id, 2) AS BIGINT) % 3 > 0 GROUP BY 1)
    SELECT (SELECT min(barcode) FROM counts WHERE "count" > 10 AND cast(substr(vcrs_id, 2) AS BIGINT) % 3 > 0) AS barcode, vcrs_id, "count" FROM b""", "counts")
def binary_sums(spark, d):
    c = T.counts(spark, d)
    gone = c.select("vcrs_id").filter("int(substr(vcrs_id, 2)) % 3 = 0")
    return C.binary(C.sum_rows(C.drop_empty(C.keep_variants(C.min_counts(c, 11), gone, keep=False))))


@query("""+ g AS (SELECT vcrs_id FROM counts WHERE "count" > 0 GROUP BY 1) SELECT 'G' || (cast(substr(vcrs_id, 2) AS BIGINT) % 7) AS gene, count(*) AS gene_count FROM g GROUP BY 1""", "counts")
def gene_counts(spark, d):
    c = T.counts(spark, d)
    genes = c.select("vcrs_id").distinct().select("vcrs_id", F.expr("'G' || (bigint(substr(vcrs_id, 2)) % 7)").alias("gene"))
    return C.gene_counts(c, genes)


@query("""+ r AS (SELECT read_index, barcode, t1, CASE WHEN t1 = t2 THEN NULL ELSE 'G' || right(t2, 1) END AS seen FROM bus), z AS (SELECT *, 'G' || right(t1, 1) AS g FROM r),
    s AS (SELECT g, count(*) FILTER (seen IS NOT NULL AND seen <> g) / count(*) AS ratio FROM z GROUP BY 1), k AS (SELECT * FROM z JOIN s USING (g) WHERE seen IS NULL OR seen = g OR ratio > 0.6)
    SELECT barcode, t1 AS vcrs_id, count(*)::DOUBLE AS "count" FROM k GROUP BY ALL""", "bus")
def recount_with_mistakes(spark, d):
    b = T.bus(spark, d)
    gene = lambda c: F.concat(F.lit("G"), F.right(F.col(c), F.lit(1)))
    reads = b.select("barcode", "read_index", F.array("t1").alias("targets"))
    genome = b.filter("t1 <> t2").select("barcode", "read_index", F.array(gene("t2")).alias("genes"))
    genes = spark.range(10).select(F.expr("'T' || id").alias("vcrs_id"), F.array(F.expr("'G' || id")).alias("genes"))
    return C.recount_by_genome(reads, genome, genes, mistake_ratio=0.6)


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 20), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity <= 30)
    SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS "TP", (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS "FP", (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS "FN" """)
def set_sizes(spark, d):
    t = T.read(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_quantity")
    return E.set_comparison(t.filter("l_quantity > 20").select("k"), t.filter("l_quantity <= 30").select("k"), "k")


@query("""+ t AS (SELECT 'T' || (l_partkey % 300) AS transcript_id, min(l_partkey) AS s, max(l_partkey) + 9 AS e FROM lineitem GROUP BY 1),
    v AS (SELECT 'T' || (doc_id % 450) AS tid, seq_id, variant FROM variants WHERE NOT contains(variant, 'dup'))
    SELECT seq_id, variant, tid, coalesce(s, 0) AS s, coalesce(e, 9999999) AS e, CASE WHEN s IS NULL THEN '.' ELSE '+' END AS strand FROM v LEFT JOIN t ON transcript_id = tid""", "variants")
def transcript_bounds(spark, d):
    name = F.concat(F.lit("T"), (F.col("l_partkey") % 300).cast("string")).alias("transcript_id")
    gtf = T.read(spark, d, "lineitem").groupBy(name).agg(F.min("l_partkey").alias("start"), (F.max("l_partkey") + 9).alias("end"))
    gtf = gtf.withColumns({"feature": F.lit("transcript"), "strand": F.lit("+"), "transcript_id": F.concat("transcript_id", F.lit(".3"))})
    v = T.variants(spark, d).withColumn("tid", F.concat(F.lit("T"), (F.col("doc_id") % 450).cast("string")))
    out = B.with_transcript_bounds(B.without_duplications(v, "variant"), gtf, "tid")
    return out.select("seq_id", "variant", "tid", F.col("start_transcript_position").alias("s"), F.col("end_transcript_position").alias("e"), "strand")


@query("""+ h AS (SELECT seq_id || ':' || variant AS h, seq_id, pos FROM variants), m AS (SELECT string_agg(h, ';' ORDER BY h) AS w, list(h) AS names FROM h WHERE pos % 4 > 0 GROUP BY seq_id, pos // 3),
    e AS (SELECT unnest(names) AS h, w FROM m) SELECT h.h AS read_header, coalesce(w, h.h) AS reference_header FROM h LEFT JOIN e USING (h)""", "variants")
def reference_headers(spark, d):
    v = T.variants(spark, d).withColumn("h", F.concat("seq_id", F.lit(":"), "variant"))
    merged = v.filter("pos % 4 > 0").groupBy("seq_id", F.floor(F.col("pos") / 3).alias("p")).agg(F.array_join(F.array_sort(F.collect_list("h")), ";").alias("header"))
    return A.reference_headers(v.select(F.col("h").alias("read_header")), merged)


@query("""+ a AS (SELECT seq_id, seq FROM dna WHERE doc_id % 3 = 0), b AS (SELECT seq_id, seq FROM dna WHERE doc_id % 3 > 0 AND seq_id NOT IN (SELECT 'S' || (o_custkey * 7) FROM orders))
    SELECT seq_id, md5(seq) AS hashed FROM a UNION ALL SELECT seq_id, md5(seq) FROM b""", "dna")
def sequences_of(spark, d):
    t = T.dna(spark, d).select("seq_id", "doc_id", F.col("seq").alias("sequence"))
    named = T.read(spark, d, "orders").select(F.concat(F.lit("S"), (F.col("o_custkey") * 7).cast("string")).alias("seq_id"))
    a = A.sequences_of(t, t.filter("doc_id % 3 = 0"))
    b = A.sequences_of(t.filter("doc_id % 3 > 0"), named, keep=False)
    return a.unionByName(b).select("seq_id", S.kmer_hash("sequence").alias("hashed"))


@query("""+ r AS (SELECT doc_id, seq, substr(seq, 1 + doc_id % 20, 12) AS part FROM dna WHERE length(seq) >= 60), p AS (SELECT *, instr(seq, part) AS spot FROM r)
    SELECT doc_id, substr(seq, greatest(spot + 12 - 40, 1), 40) AS leftmost, substr(seq, least(spot, length(seq) - 39), 40) AS rightmost FROM p""", "dna")
def windows_around(spark, d):
    t = T.dna(spark, d).filter("length(seq) >= 60").withColumn("part", F.expr("substr(seq, 1 + doc_id % 20, 12)"))
    return t.select("doc_id", S.window_around("seq", "part", 40, F.lit(0.0)).alias("leftmost"), S.window_around("seq", "part", 40, F.lit(0.999999)).alias("rightmost"))


@query("""+ t AS (SELECT seq_id || ':' || variant AS header, substr(seq, pos, 20) AS s, substr(seq, pos, 20 + pos % 2) AS w FROM variants JOIN dna USING (seq_id)),
    m AS (SELECT string_agg(header, ';' ORDER BY header) AS vcrs_header, arg_min(s, header) AS vcrs_sequence, count(DISTINCT w) AS n FROM t GROUP BY s)
    SELECT vcrs_header, vcrs_sequence FROM m WHERE n = 1""", "variants", "dna")
def one_wild_type(spark, d):
    v = T.variants(spark, d).join(T.dna(spark, d).select("seq_id", "seq"), "seq_id")
    v = v.select(F.concat("seq_id", F.lit(":"), "variant").alias("header"), F.expr("substr(seq, int(pos), 20)").alias("vcrs_sequence"), F.expr("substr(seq, int(pos), int(20 + pos % 2))").alias("wt_sequence"), F.lit(0).alias("original_order"))
    merged = B.merge_identical(v, reverse_complements=False, keep_wild_types=True)
    return A.one_wild_type(merged).select("vcrs_header", "vcrs_sequence")
