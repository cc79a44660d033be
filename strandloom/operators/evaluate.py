"""Classification metrics, comparisons of tables, and the aggregates behind the plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hgvs as H
from ..functions import quality as Q
from .fixed import fixed

BASES = ["A", "C", "G", "T"]


def confusion(truth: Column, called: Column) -> dict[str, Column]:
    return {
        "TP": F.count_if(truth & called), "FP": F.count_if(~truth & called),
        "FN": F.count_if(truth & ~called), "TN": F.count_if(~truth & ~called),
    }


def metrics(df: DataFrame, truth: str, called: str, by: list[str] | None = None) -> DataFrame:
    """TP, FP, FN, TN and accuracy, sensitivity, specificity, precision, F1 (of each group)."""
    out = df.groupBy(*(by or [])).agg(*(c.alias(n) for n, c in confusion(F.col(truth), F.col(called)).items()))
    return out.withColumns(
        {
            "accuracy": F.try_divide((F.col("TP") + F.col("TN")).cast("double"), F.col("TP") + F.col("TN") + F.col("FP") + F.col("FN")),
            "sensitivity": Q.sensitivity("TP", "FN"),
            "specificity": Q.specificity("TN", "FP"),
            "precision": Q.precision("TP", "FP"),
            "f1": Q.f1_score("TP", "FP", "FN"),
        }
    )


def bin_label(value, edges: list[float]) -> Column:
    """'(a, b]' of the right-closed bin; null outside."""
    c = F.col(value) if isinstance(value, str) else value
    out = F.lit(None).cast("string")
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out = F.when((c > a) & (c <= b), f"({a}, {b}]").otherwise(out)
    return out


def stratified_metrics(df: DataFrame, truth: str, called: str, value: str, edges: list[float]) -> DataFrame:
    binned = df.withColumn("bin", bin_label(value, edges)).filter("bin IS NOT NULL")
    return metrics(binned, truth, called, ["bin"])


def compare_maps(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of two tables that differ: status only_left, only_right or different."""
    left = a.select(key, F.struct(F.col(value).alias("v")).alias("_l"))
    right = b.select(key, F.struct(F.col(value).alias("v")).alias("_r"))
    both = left.join(right, key, "full")
    status = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(~F.col("_l").eqNullSafe(F.col("_r")), "different")
    return both.select(key, status.alias("status")).filter("status IS NOT NULL")


def set_comparison(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: TP, FP, FN of two sets of keys."""
    t = truth.select(key).distinct().withColumn("t", F.lit(1))
    f = found.select(key).distinct().withColumn("f", F.lit(1))
    both = t.join(f, key, "full")
    return both.agg(
        F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("TP"),
        F.count_if(F.col("t").isNull()).alias("FP"),
        F.count_if(F.col("f").isNull()).alias("FN"),
    )


def substitution_spectrum(variants: DataFrame, header: str = "header", weight: str | None = None) -> DataFrame:
    """ref, alt and their (weighted) number among substitutions."""
    parts = {"_kind": H.variant_type(header), "_change": H.variant_change(header)}
    rows = fixed(variants, parts).filter("_kind = 'substitution'").select(
        F.substring("_change", 1, 1).alias("ref"), F.substring("_change", -1, 1).alias("alt"), (F.col(weight) if weight else F.lit(1)).alias("w")
    )
    return rows.filter(F.col("ref").isin(BASES) & F.col("alt").isin(BASES)).groupBy("ref", "alt").agg(F.sum("w").alias("n"))


def type_frequencies(variants: DataFrame, header: str = "header") -> DataFrame:
    """All six types with their numbers, 0 included."""
    listed = variants.sparkSession.sql("SELECT explode(array(" + ", ".join(f"'{t}'" for t in H.TYPES) + ")) AS variant_type")
    counts = variants.groupBy(H.variant_type(header).alias("variant_type")).agg(F.count("*").alias("n"))
    return listed.join(counts, "variant_type", "left").select("variant_type", F.coalesce("n", F.lit(0)).alias("n"))


def log_histogram(df: DataFrame, column: str, bins: int, high: float) -> DataFrame:
    """Numbers of values in equal bins of log10(1 + value) up to log10(1 + high)."""
    bucket = F.width_bucket(F.log10(1 + F.col(column)), F.lit(0.0), F.log10(F.lit(1.0 + high)), F.lit(bins))
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
