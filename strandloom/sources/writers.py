"""Text sinks.  Each writes a folder of parts, as Spark does; ``single`` asks for one part."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fixed import materialised
from ..operators.number import row_numbers


def _text(df: DataFrame, path: str, mode: str, single: bool) -> None:
    (df.coalesce(1) if single else df).write.mode(mode).text(path)


def write_fasta(df: DataFrame, path: str, id_col: str = "vcrs_id", seq_col: str = "vcrs_sequence", mode: str = "errorifexists", single: bool = False) -> None:
    _text(df.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.col(seq_col)).alias("value")), path, mode, single)


def write_fastq(df: DataFrame, path: str, mode: str = "errorifexists", single: bool = False) -> None:
    line = F.concat(F.lit("@"), "header", F.lit("\n"), "sequence", F.lit("\n+\n"), "quality")
    _text(df.select(line.alias("value")), path, mode, single)


def write_fastq_by_gene(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per gene with the reads that count for it (column genes)."""
    line = F.concat(F.lit("@"), "header", F.lit("\n"), "sequence", F.lit("\n+\n"), "quality")
    df.select(F.explode("genes").alias("gene"), line.alias("value")).write.mode(mode).partitionBy("gene").text(path)


def write_t2g(df: DataFrame, path: str, id_col: str = "vcrs_id", mode: str = "errorifexists") -> None:
    df.select(F.col(id_col).alias("a"), F.col(id_col).alias("b")).write.mode(mode).option("sep", "\t").csv(path)


def write_id_map(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("vcrs_id", "vcrs_header").write.mode(mode).option("header", True).csv(path)


def vcf_lines(records: DataFrame, samples: bool = False) -> DataFrame:
    """Body lines of a VCF of CHROM, POS, ID, REF, ALT, AO, NS (AF): column value, with CHROM and POS."""
    info = F.concat(F.lit("AO="), F.col("AO").cast("long").cast("string"), F.lit(";NS="), F.col("NS").cast("string"))
    if "AF" in records.columns:
        info = F.concat(info, F.lit(";AF="), F.col("AF").cast("string"))
    line = F.concat_ws("\t", "CHROM", F.col("POS").cast("string"), "ID", "REF", "ALT", F.lit("."), F.lit("PASS"), info)
    if samples:
        line = F.concat_ws("\t", line, F.lit("AO"), F.array_join("sample_counts", "\t"))
    return records.select("CHROM", "POS", line.alias("value"))


def write_vcf(records: DataFrame, path: str, sample_names: list[str] | None = None, mode: str = "errorifexists") -> None:
    head = ["##fileformat=VCFv4.2", '##INFO=<ID=AO,Number=1,Type=Integer,Description="Alternate reads">', '##INFO=<ID=NS,Number=1,Type=Integer,Description="Samples with the variant">']
    if sample_names:
        head.append('##FORMAT=<ID=AO,Number=1,Type=Integer,Description="Alternate reads of the sample">')
    head.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *sample_names] if sample_names else [])]))
    body = vcf_lines(records, bool(sample_names)).orderBy("CHROM", "POS").select("value")
    top = records.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1)
    top.union(body).write.mode(mode).text(path)


def write_counts(matrix: DataFrame, path: str, mode: str = "errorifexists") -> None:
    matrix.write.mode(mode).parquet(path)


def write_matrix_market(matrix: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``path``/barcodes.txt, genes.txt and matrix.mtx (barcodes by genes, from 1), each a folder of parts in order.

    Names are numbered by ranges, and cells are written in the order of barcode and gene, so no task sees all of them.
    """
    names = {}
    for column, name in (("barcode", "barcodes"), ("vcrs_id", "genes")):
        names[column] = materialised(row_numbers(matrix.select(column).distinct(), column, name=f"_{column}"))
        names[column].orderBy(f"_{column}").select(F.col(column).alias("value")).write.mode(mode).text(f"{path}/{name}.txt")
    cells = materialised(matrix.filter("count <> 0").groupBy("barcode", "vcrs_id").agg(F.sum("count").alias("count")))
    sizes = [names["barcode"].count(), names["vcrs_id"].count(), cells.count()]
    head = f"%%MatrixMarket matrix coordinate real general\n{' '.join(map(str, sizes))}"
    top = matrix.sparkSession.createDataFrame([(head,)], "value string").coalesce(1)
    rows = cells.join(names["barcode"], "barcode").join(names["vcrs_id"], "vcrs_id").orderBy("_barcode", "_vcrs_id")
    shown = F.when(F.col("count") == F.floor("count"), F.col("count").cast("long").cast("string")).otherwise(F.col("count").cast("string"))
    top.union(rows.select(F.concat_ws(" ", "_barcode", "_vcrs_id", shown).alias("value"))).write.mode(mode).text(f"{path}/matrix.mtx")


def write_removed(checked: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The headers of variants that were left out for good, one a line; ``checked``: header, drop_reason."""
    kept = checked.filter("drop_reason IS NULL").select("header").distinct()
    gone = checked.filter("drop_reason IS NOT NULL AND header IS NOT NULL").select("header").distinct()
    gone.join(kept, "header", "left_anti").select(F.col("header").alias("value")).write.mode(mode).text(path)


def write_config(params: dict, path: str) -> None:
    """Parameters as JSON; passwords are masked."""
    hidden = {k: ("*****" if "password" in k.lower() and v else v) for k, v in params.items()}
    Path(path).write_text(json.dumps(hidden, indent=2, default=str), encoding="utf-8")


def swap_names(seqs: DataFrame, id_map: DataFrame, to: str = "vcrs_header", of: str = "vcrs_id") -> DataFrame:
    """Sequences under the map's other name."""
    return seqs.join(id_map, seqs["seq_id"] == id_map[of]).select(F.col(to).alias("seq_id"), "sequence")
