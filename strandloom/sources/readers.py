"""Text formats as DataFrames.  Paths may be in any store that Spark reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hgvs as H
from .fastq import read_fastq  # noqa: F401

GTF = T.StructType([T.StructField(n, t) for n, t in (
    ("seqname", T.StringType()), ("source", T.StringType()), ("feature", T.StringType()), ("start", T.LongType()), ("end", T.LongType()),
    ("score", T.StringType()), ("strand", T.StringType()), ("frame", T.StringType()), ("attributes", T.StringType()))])


def read_fasta(spark: SparkSession, path, *, split_headers: bool = False, id_only: bool = True) -> DataFrame:
    """seq_id, title, sequence.  Records split at '\\n>', so a '>' in a title does no harm."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    title = F.trim(F.regexp_extract(record, r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace(record, r"^[^\n]*\n?", ""), r"\s", "")
    rows = raw.select(title.alias("title"), body.alias("sequence")).filter("title <> '' OR sequence <> ''")
    if split_headers:
        rows = rows.select(F.explode(F.split("title", ";")).alias("title"), "sequence")
    return rows.select((H.fasta_id("title") if id_only else F.col("title")).alias("seq_id"), "title", "sequence")


def ordered_lines(spark: SparkSession, path) -> DataFrame:
    """value, and the line's place ``_o`` in the order of files, their blocks and lines; partitions come in no such order."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", place.alias("_o"))


def list_fastqs(spark: SparkSession, source: str | list[str]) -> list[str]:
    """Paths of FASTQ files: a list of them, a folder, a text file that lists them, or one file."""
    if not isinstance(source, str):
        return list(source)
    if source.endswith(".txt"):
        return [r["value"].strip() for r in spark.read.text(source).filter("trim(value) <> ''").collect()]  # names only
    if re.search(r"\.(fastq|fq)(\.\w+)?$", source):
        return [source]
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{fastq,fq,fastq.gz,fq.gz}").load(source).select("path")
    return sorted(r["path"] for r in found.collect())  # names only


def concatenated(reads: list[DataFrame]) -> DataFrame:
    """Reads of several files as those of one; file_index tells them apart."""
    out = reads[0].withColumn("file_index", F.lit(0))
    for i, other in enumerate(reads[1:], 1):
        out = out.unionByName(other.withColumn("file_index", F.lit(i)))
    return out


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV, TSV or Parquet by the name's ending; without a schema all columns are text."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("sep", "\t" if ".tsv" in path or path.endswith(".txt") else ",")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_vcf(spark: SparkSession, path, *, explode_alt: bool = True, drop_empty: bool = True) -> DataFrame:
    """CHROM, POS, ID, REF, ALT, QUAL, FILTER, INFO (map), FORMAT, samples (array)."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    rows = lines.select(
        at(0).alias("CHROM"), at(1).cast("long").alias("POS"), at(2).alias("ID"), at(3).alias("REF"), at(4).alias("ALT"), at(5).alias("QUAL"),
        at(6).alias("FILTER"), F.str_to_map(at(7), F.lit(";"), F.lit("=")).alias("INFO"), at(8).alias("FORMAT"),
        F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))).alias("samples"),
    )
    if explode_alt:
        rows = rows.withColumn("ALT", F.explode(F.split("ALT", ",")))
    return rows.filter(F.col("ALT").isNotNull() & ~F.col("ALT").isin("", ".")) if drop_empty else rows


def vcf_variants(records: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """VCF records with variant (HGVS) and variant_type; with sequences, long duplications are found."""
    out = records.withColumns({"variant": H.vcf_variant("POS", "REF", "ALT"), "variant_type": H.vcf_type("REF", "ALT")})
    if sequences is None:
        return out
    from ..operators.build import windows

    n = F.length("ALT")
    out = out.withColumns({"seq_id": F.col("CHROM"), "_low": F.col("POS") - n + 1, "_high": F.col("POS")})
    out = windows(out, sequences, "_low", "_high", "_before")
    name = H.long_duplication("POS", "REF", "ALT", "_before")
    kind = F.when(name.isNotNull(), "duplication").otherwise(F.col("variant_type"))
    return out.withColumns({"variant": F.coalesce(name, "variant"), "variant_type": kind}).drop("_low", "_high", "_before", "seq_id")


def without_chr(records: DataFrame, sequences: DataFrame) -> DataFrame:
    """VCF records whose CHROM loses a leading chr, if no name in ``sequences`` (seq_id) begins with it."""
    named = sequences.agg(F.coalesce(F.max(F.col("seq_id").startswith("chr")), F.lit(False)).alias("_chr"))  # one row
    plain = F.when(F.col("_chr"), F.col("CHROM")).otherwise(F.regexp_replace("CHROM", "^chr", ""))
    return records.crossJoin(F.broadcast(named)).withColumn("CHROM", plain).drop("_chr")


def read_gtf(spark: SparkSession, path) -> DataFrame:
    """The nine columns, and gene_id, transcript_id and gene_name from the attributes."""
    rows = spark.read.schema(GTF).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    key = lambda k: F.nullif(F.regexp_extract("attributes", f'{k} "([^"]+)"', 1), F.lit(""))
    return rows.withColumns({k: key(k) for k in ("gene_id", "transcript_id", "gene_name")})


def splice_junctions(gtf: DataFrame) -> DataFrame:
    """seq_id, position: the distinct ends of all exons."""
    exons = gtf.filter("feature = 'exon'")
    return exons.select(F.col("seqname").alias("seq_id"), F.explode(F.array("start", "end")).alias("position")).distinct()


def transcript_genes(gtf: DataFrame, strip_versions: bool = False) -> DataFrame:
    rows = gtf.filter("feature = 'transcript'").select("transcript_id", "gene_id")
    return rows.select(*(H.without_version(c).alias(c) for c in rows.columns)).distinct() if strip_versions else rows.distinct()


def read_t2g(spark: SparkSession, path, *, strip_versions: bool = False, columns: tuple[int, int] = (0, 1)) -> DataFrame:
    """transcript_id, gene_id; the last line of a transcript counts, and dlist maps to itself."""
    f = F.split("value", "\t")
    rows = ordered_lines(spark, path).select(*(F.get(f, F.lit(c)).alias(n) for c, n in zip(columns, ("transcript_id", "gene_id"), strict=True)), F.col("_o").alias("o"))
    if strip_versions:
        rows = rows.withColumns({c: H.without_version(c) for c in ("transcript_id", "gene_id")})
    rows = rows.groupBy("transcript_id").agg(F.max_by("gene_id", "o").alias("gene_id"))
    return rows.filter("transcript_id <> 'dlist'").union(spark.sql("SELECT 'dlist' AS transcript_id, 'dlist' AS gene_id"))


def read_id_map(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("header", True).schema("vcrs_id string, vcrs_header string").csv(path)


def read_matrix_market(spark: SparkSession, matrix, barcodes, genes) -> DataFrame:
    """(barcode, vcrs_id, count) of a MatrixMarket file and its two lists of names."""
    lines = ordered_lines(spark, matrix).filter(~F.col("value").startswith("%"))
    head = lines.agg(F.min("_o").alias("_o"))
    f = F.split(F.trim("value"), r"\s+")
    cells = lines.join(F.broadcast(head), "_o", "left_anti").select(f[0].cast("long").alias("i"), f[1].cast("long").alias("j"), f[2].cast("double").alias("count"))

    def named(path, name, index):
        from ..operators.number import row_numbers

        rows = ordered_lines(spark, path).withColumnRenamed("value", name)
        return row_numbers(rows, "_o", name=index).drop("_o")

    return cells.join(named(barcodes, "barcode", "i"), "i").join(named(genes, "vcrs_id", "j"), "j").select("barcode", "vcrs_id", "count")


def read_bus_text(spark: SparkSession, path) -> DataFrame:
    """barcode, umi, ec, count, read_index of BUS records as text."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(
        f[0].alias("barcode"), f[1].alias("umi"), f[2].cast("int").alias("ec"), f[3].cast("long").alias("count"), F.get(f, F.lit(4)).cast("long").alias("read_index")
    )


def read_equivalence_classes(spark: SparkSession, path, transcripts) -> DataFrame:
    """ec and its target names; the index after the last name is dlist."""
    from ..operators.number import row_numbers

    names = row_numbers(ordered_lines(spark, transcripts).withColumnRenamed("value", "target"), "_o", name="_n")
    names = names.select((F.col("_n") - 1).cast("long").alias("t"), "target")
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(f[0].cast("int").alias("ec"), F.explode(F.split(f[1], ",")).alias("t")).withColumn("t", F.col("t").cast("long"))
    named = rows.join(names, "t", "left").withColumn("target", F.coalesce("target", F.lit("dlist")))
    return named.groupBy("ec").agg(F.array_sort(F.collect_list(F.struct("t", "target"))).alias("x")).select("ec", F.col("x.target").alias("targets"))


def read_sam(spark: SparkSession, path, exact: int | None = None) -> DataFrame:
    """id (query name up to its last '_'), query, reference, pos, cigar, end; with ``exact`` only cigars {k}=."""
    from ..functions.sequence import cigar_end

    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("@")).select(
        f[0].alias("query"), f[2].alias("reference"), f[3].cast("long").alias("pos"), f[5].alias("cigar")
    )
    rows = rows.filter(F.col("cigar") == f"{exact}=") if exact else rows
    return rows.select(F.regexp_replace("query", "_[^_]*$", "").alias("id"), "*", cigar_end("pos", "cigar").alias("end"))


def read_list(spark: SparkSession, path, name: str = "value") -> DataFrame:
    """The lines that are not blank, without the space around them."""
    return spark.read.text(path).select(F.trim("value").alias(name)).filter(F.col(name) != "")
