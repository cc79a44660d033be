"""A training-corpus pipeline over ``documents``, in stages that each apply one operator.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written and read again as the next stage's docs.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from strandloom.llm.common import picked, shared_dir, table
from strandloom.llm.decontaminate import contamination
from strandloom.llm.line_dedup import deduplicate_lines, row_key
from strandloom.llm.minhash import near_duplicates
from strandloom.llm.packing import pack
from strandloom.llm.quality import score_quality, train_model
from strandloom.llm.queries import TOKENIZER

#: Documents scored below this are rejected.
MIN_QUALITY = 0.3
#: A row's own key: its id, which may be null or repeat, and its text.
KEY = "_sl_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, row_key("doc_id", F.coalesce("text", F.lit(""))))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed ``docs`` without the rows with these keys."""
    return picked(docs, keys, "left_anti").drop(KEY)


def _kept(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.  All labels may be learned from here.

    Each row is judged by its text; a null text counts as empty, and a null id does no harm.
    """
    model = train_model(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), F.lit(True))
    keyed = _keyed(docs)
    scored = score_quality(keyed, docs.limit(0), F.lit(True), id_col=KEY, threshold=MIN_QUALITY, model=model)
    rejected = scored.filter("predicted = 0").select(F.col("doc_id").alias(KEY)).distinct()
    return _without(keyed, _kept(rejected, spark, "rejected"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later occurrences of repeated runs of lines; a document that is left empty goes.

    ``n_chars`` follows the text.
    """
    cleaned = deduplicate_lines(docs)
    emptied = F.col("_sl_removed").isNotNull() & ~F.col("text").rlike(r"\S")
    cleaned = cleaned.filter(~emptied)
    size = F.when(F.col("_sl_removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.withColumn("n_chars", size).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    A row without an id takes part under a large number made from its text, so a near copy that has
    an id stays in its place.  Rows with null or blank texts are near nothing and stay.
    """
    keyed = _keyed(docs)
    if isinstance(docs.schema["doc_id"].dataType, LongType | IntegerType):
        own = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2) + (1 << 62))
        keyed = keyed.withColumn(KEY, own)
    else:
        keyed = keyed.withColumn(KEY, F.col("doc_id"))
    groups = near_duplicates(keyed, words=5, percent=80, id_col=KEY)
    gone = groups.filter("NOT kept").select(F.col("doc_id").alias(KEY)).distinct()
    return _without(keyed, _kept(gone, spark, "near"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; null ids and null texts do no harm."""
    keyed = _keyed(docs)
    found = contamination(keyed, table(spark, sf_dir, "benchmark"), id_col=KEY)
    gone = found.select(F.col("doc_id").alias(KEY)).distinct()
    return _without(keyed, _kept(gone, spark, "contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 2048 tokens.

    A null text is packed as an empty one; each row is a document, whatever its id.
    """
    return pack(docs, TOKENIZER, capacity=2048)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("decontamination", benchmark),
    ("packing", packing),
]

#: SQL cannot express the classifier, the MinHash groups and the alignment.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _kept(stage(spark, docs, sf_dir), spark, name)
    return STAGES[-1][1](spark, docs, sf_dir)
