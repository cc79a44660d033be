"""The ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import decoded, encoded
from .common import fold, table
from .decontaminate import contamination
from .exact_dedup import exact_groups
from .fill_middle import fill_in_middle
from .language_id import identify
from .line_dedup import deduplicate_lines
from .minhash import near_duplicates
from .packing import pack
from .quality import score_quality
from .resample import importance_ranks
from .sharding import kd_shards
from .token_counts import token_counts
from .toxicity import score_toxicity

#: The vocabulary, a parameter of the operators: a path, or the name of an installed public one.
TOKENIZER = "word_bpe_49k.json"
#: The ranks of op12, likewise.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _held_out(mod: int, rest: int):
    return F.coalesce(fold(F.col("doc_id"), mod) == rest, F.lit(False))


def _trained(scored: DataFrame, mod: int, rest: int) -> DataFrame:
    first, *others = scored.columns
    return scored.select(first, _held_out(mod, rest).alias("held_out"), *others)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = deduplicate_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id",
        F.col("_sl_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_sl_removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join("_sl_removed", " ").alias("removed_lines"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _trained(score_quality(docs, labels, ~_held_out(5, 0)), 5, 0)


def op4_toxicity_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _trained(score_toxicity(docs, labels, ~_held_out(4, 2)), 4, 2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(identify(table(spark, sf_dir, "documents"), ~_held_out(5, 0)), 5, 0)


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(table(spark, sf_dir, "documents"), shards=24)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), TOKENIZER, limit=2048)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=(5, 100), min_words=20)
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decoded(encoded(table(spark, sf_dir, "documents"), RANKS), RANKS)
    ids = F.translate(F.to_json("ids"), "[]", "")  # decimal numbers and commas
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), returns=("output_sha256", "restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_gam": op3_quality_gam,
    "op4_toxicity_weak_supervision": op4_toxicity_weak_supervision,
    "op6_language_id": op6_language_id,
    "op5_kd_sharding": op5_kd_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_fill_in_middle": op13_fill_in_middle,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: CRC-32 of a text, four bits at a time; ``digits`` are the hex digits of its bytes, the low one of each byte first.
_DIGITS = "list_transform(range(0, 2 * octet_length(encode(f))), lambda i: instr('123456789ABCDEF', substr(hex(encode(f)), i + 2 - 2 * (i % 2), 1)))"
_NIBBLES = [0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
            0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C]
_CRC32 = f"""xor(list_reduce({_DIGITS}, lambda c, d: xor(c >> 4, ({_NIBBLES})[(xor(c, d) & 15) + 1]), 4294967295), 4294967295)"""


def _ngrams(source: str) -> str:
    """Words, and runs of one to three words, of every text of a table."""
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    two = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    three = "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
    return f"SELECT *, w || {two} || {three} AS fs FROM (SELECT *, {words} AS w FROM {source})"



ORACLES: dict[str, str] = {
    "op8_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM t""",
    "op11_importance_resampling": f"""
        WITH d AS ({_ngrams("documents")}), b AS ({_ngrams("benchmark")}),
        df AS (SELECT doc_id, unnest(fs) AS f FROM d), bf AS (SELECT unnest(fs) AS f FROM b),
        code AS MATERIALIZED (SELECT f, {_CRC32} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
        corpus AS (SELECT bucket, count(*) AS s FROM df JOIN code USING (f) GROUP BY bucket),
        target AS (SELECT bucket, count(*) AS t FROM bf JOIN code USING (f) GROUP BY bucket),
        total AS (SELECT (SELECT coalesce(sum(s), 0) FROM corpus)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS all_t),
        gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000) / ((s::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain
            FROM corpus LEFT JOIN target USING (bucket), total),
        summed AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM df JOIN code USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
        scored AS (SELECT doc_id, len(w) AS n, len(fs) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM d LEFT JOIN summed USING (doc_id)),
        ranked AS (SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) END AS place,
            count(*) FILTER (n >= 20) OVER () AS able FROM scored)
        SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= 5 * able // 100 THEN place END AS rank FROM ranked""",
    "op13_fill_in_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
            regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS k FROM documents),
        u AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(k) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(k) + 1) AS b,
            text <> '' AND NOT regexp_matches(text, '<[PSM]>') AND CAST('0x' || h[17:24] AS BIGINT) % 100 < 50 AS cut,
            CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 AS spm FROM t),
        p AS (SELECT *, array_to_string(k[1:least(a, b)], '') AS head, array_to_string(k[1:greatest(a, b)], '') AS upto FROM u),
        q AS (SELECT *, substr(upto, length(head) + 1) AS mid, substr(text, length(upto) + 1) AS tail FROM p)
        SELECT doc_id, CAST(len(k) AS BIGINT) AS n, CASE WHEN NOT cut THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
            CASE WHEN cut THEN length(head) END AS prefix_chars, CASE WHEN cut THEN length(mid) END AS middle_chars,
            sha256(CASE WHEN NOT cut THEN text WHEN spm THEN '<S>' || tail || '<P>' || head || '<M>' || mid
                ELSE '<P>' || head || '<S>' || tail || '<M>' || mid END) AS output_sha256,
            sha256(text) AS restored_sha256 FROM q""",
}
