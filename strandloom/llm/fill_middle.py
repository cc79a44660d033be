"""Fill-in-the-middle: texts are cut into prefix, middle and suffix, and put together in another order.

The work on a batch is SQL: DuckDB reads the Arrow batch inside the task, cuts texts into tokens,
draws the cuts from SHA-256 of the id, and gives Arrow back.  No row becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers
from .ragged import byte_slices

#: A token: white space with the word behind it, or white space at the end of the text.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What can be asked for besides doc_id, n, form, prefix_chars and middle_chars.
RETURNS = {"output": "string", "restored": "string", "output_sha256": "string", "restored_sha256": "string"}
#: Bytes of texts in one DuckDB query; a longer text has a query of its own.
QUERY_BYTES = 1 << 22


def cut_sql(source: str, *, seed: int = 42, plain_percent: int = 50, spm_percent: int = 80) -> str:
    """Columns _row, doc_id, n, form, prefix, middle, suffix, text of ``source`` (_row, doc_id, text without nulls)."""
    draw = lambda i: f"CAST('0x' || substr(digest, {8 * i - 7}, 8) AS BIGINT)"
    marked = " OR ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    part = lambda a, b: f"array_to_string(list_slice(tokens, {a}, {b}), '')"
    return f"""
        WITH split AS (
            SELECT _row, doc_id, text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
                regexp_extract_all(text, '{TOKEN}') AS tokens FROM {source}),
        drawn AS (
            SELECT *, CAST(len(tokens) AS BIGINT) AS n, {draw(1)} % (len(tokens) + 1) AS a, {draw(2)} % (len(tokens) + 1) AS b,
                CASE WHEN text = '' OR {marked} OR {draw(3)} % 100 >= {plain_percent} THEN 'plain'
                     WHEN {draw(4)} % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM split)
        SELECT _row, doc_id, n, form, text,
            CASE WHEN form <> 'plain' THEN {part(1, "least(a, b)")} END AS prefix,
            CASE WHEN form <> 'plain' THEN {part("least(a, b) + 1", "greatest(a, b)")} END AS middle,
            CASE WHEN form <> 'plain' THEN {part("greatest(a, b) + 1", "n")} END AS suffix
        FROM drawn"""


def join_sql(source: str) -> str:
    """``source`` (see ``cut_sql``) with prefix_chars, middle_chars and output."""
    return f"""
        SELECT _row, doc_id, n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
            CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                      WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle
                      ELSE text END AS output
        FROM {source}"""


def restore_sql(source: str) -> str:
    """``source`` (form, output and more) with ``restored``: the text, from form and output alone.

    A text that was cut has no marker of its own, and none can arise where pieces meet, so the first
    marker of each kind is the one that was put there.
    """
    second = f"CASE form WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END"
    return f"""
        SELECT * EXCLUDE (_halves, _rest),
            CASE form WHEN 'psm' THEN _halves[1] || _rest[2] || _rest[1]
                      WHEN 'spm' THEN _rest[1] || _rest[2] || _halves[1] ELSE output END AS restored
        FROM (SELECT *, CASE WHEN form <> 'plain' THEN string_split(_halves[2], '{MIDDLE}') END AS _rest FROM (
            SELECT *, CASE WHEN form <> 'plain' THEN string_split(substr(output, 4), {second}) END AS _halves FROM {source}))"""


def whole_sql(source: str, returns: Sequence[str], **options) -> str:
    values = {"output": "output", "restored": "restored", "output_sha256": "sha256(output)", "restored_sha256": "sha256(restored)"}
    return f"""
        WITH cut AS ({cut_sql(source, **options)}), joined AS ({join_sql("cut")}), restored AS ({restore_sql("joined")})
        SELECT {", ".join(["doc_id", "n", "form", "prefix_chars", "middle_chars", *(f"{values[r]} AS {r}" for r in returns)])}
        FROM restored ORDER BY _row"""


def connection():
    """A DuckDB of this task: one thread, bounded memory, nothing on disk."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})


def fill_in_middle(
    docs: DataFrame, *, returns: Sequence[str] = ("output",), id_col: str = "doc_id", text_col: str = "text", seed: int = 42, plain_percent: int = 50, spm_percent: int = 80
) -> DataFrame:
    """One row per input row: doc_id, n (tokens), form, prefix_chars, middle_chars (code points), and what ``returns`` names.

    ``form`` is plain (the text as it is), psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each
    part behind its marker.  Empty and null texts, and texts with a marker of their own, stay plain.
    Cuts and form depend on ``seed`` and id only, so equal ids are cut alike; a null id counts as an empty one.
    Other columns are ignored; an empty table gives no rows; nothing is shuffled.  ``returns`` may name
    output, restored (the text, rebuilt from output and form) and the SHA-256 of both.
    """
    source = on_workers(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    sql = whole_sql("batch", returns, seed=seed, plain_percent=plain_percent, spm_percent=spm_percent)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        for rows in batches:
            for first, _, offsets in byte_slices(rows.column(1), QUERY_BYTES):
                part = pa.table(rows.slice(first, len(offsets) - 1)).append_column("_row", pa.array(range(len(offsets) - 1), pa.int64()))
                con.register("batch", part)
                yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("batch")

    kinds = "".join(f", {r} {RETURNS[r]}" for r in returns)
    return source.mapInArrow(transform, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long{kinds}")


def restore(transformed: DataFrame, *, id_col: str = "doc_id", form_col: str = "form", output_col: str = "output") -> DataFrame:
    """doc_id and restored: the text of every row, rebuilt from form and output; null where output is null."""
    columns = zip(("doc_id", "form", "output"), (id_col, form_col, output_col), strict=True)
    source = on_workers(transformed).select(*(F.col(c).alias(n) for n, c in columns))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        for rows in batches:
            for first, _, offsets in byte_slices(rows.column(2).fill_null(""), QUERY_BYTES):
                part = pa.table(rows.slice(first, len(offsets) - 1)).append_column("_row", pa.array(range(len(offsets) - 1), pa.int64()))
                con.register("batch", part)
                yield from con.sql(f"SELECT doc_id, restored FROM ({restore_sql('batch')}) ORDER BY _row").to_arrow_table().to_batches()
                con.unregister("batch")

    return source.mapInArrow(rebuild, f"doc_id {id_type}, restored string")
