"""The filter language: ``COLUMN:RULE`` or ``COLUMN:RULE=VALUE``, applied one after the other."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER_RULES = ("greater_than", "greater_or_equal", "less_than", "less_or_equal", "top_percent", "bottom_percent")
RANGE_RULES = ("between_inclusive", "between_exclusive")
VALUE_RULES = ("equal", "not_equal")
SET_RULES = ("is_in", "is_not_in")
PLAIN_RULES = ("is_null", "is_not_null", "is_true", "is_false", "is_not_true", "is_not_false")
#: Sets of more values than this become a join.
LITERALS = 1000


@dataclass(frozen=True)
class Filter:
    column: str
    rule: str
    value: str | None = None

    @classmethod
    def parse(cls, text: str) -> Filter:
        m = re.fullmatch(r"([^:]+):([^=]+?)(?:=(.*))?", text, re.S)
        if not m:
            raise ValueError(f"filter must be COLUMN:RULE or COLUMN:RULE=VALUE: {text!r}")
        out = cls(m[1].strip(), m[2].strip(), m[3])
        out.check()
        return out

    def check(self) -> None:
        if self.rule in PLAIN_RULES:
            if self.value is not None:
                raise ValueError(f"rule {self.rule} takes no value")
            return
        if self.rule not in NUMBER_RULES + RANGE_RULES + VALUE_RULES + SET_RULES:
            raise ValueError(f"unknown rule {self.rule!r}")
        if self.value is None:
            raise ValueError(f"rule {self.rule} needs a value")
        if self.rule in NUMBER_RULES:
            number = float(self.value)
            if self.rule.endswith("percent") and not 0 <= number <= 100:
                raise ValueError(f"{self.rule} needs a percentage: {self.value}")
        if self.rule in RANGE_RULES:
            low, high = self.bounds()
            if low >= high:
                raise ValueError(f"the lower bound must be below the upper one: {self.value}")
        if self.rule in SET_RULES and not self.value.endswith(".txt"):
            self.values()

    def bounds(self) -> tuple[float, float]:
        try:
            low, high = map(float, self.value.split(","))
        except ValueError:
            raise ValueError(f"{self.rule} needs MIN,MAX: {self.value}") from None
        return low, high

    def values(self) -> list:
        try:
            found = ast.literal_eval(self.value)
        except (ValueError, SyntaxError):
            found = None
        if not isinstance(found, (set, list, tuple)):
            raise ValueError(f"{self.rule} needs a list, a set or a .txt file: {self.value}")
        return sorted(found, key=str)


def parse_filters(filters) -> list[Filter]:
    """Of one text, several, or a .txt file with one filter a line."""
    if isinstance(filters, str):
        if filters.endswith(".txt"):
            with open(filters, encoding="utf-8") as f:
                filters = [x.strip() for x in f if x.strip()]
        else:
            filters = [filters]
    return [f if isinstance(f, Filter) else Filter.parse(f) for f in filters]


def text_of(column: str, kind: str) -> Column:
    """A value as text: True and False, 5.0 for a whole float."""
    c = F.col(column)
    if kind == "boolean":
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def apply_filter(df: DataFrame, f: Filter) -> DataFrame:
    """Rows that pass; rules on numbers keep nulls, so do the negative ones."""
    if f.column not in df.columns:
        return df
    kind, c = dict(df.dtypes)[f.column], F.col(f.column)
    number = c.cast("double")
    match f.rule:
        case "greater_than":
            keep = (number > float(f.value)) | c.isNull()
        case "greater_or_equal":
            keep = (number >= float(f.value)) | c.isNull()
        case "less_than":
            keep = (number < float(f.value)) | c.isNull()
        case "less_or_equal":
            keep = (number <= float(f.value)) | c.isNull()
        case "between_inclusive" | "between_exclusive":
            low, high = f.bounds()
            inside = number.between(low, high) if f.rule == "between_inclusive" else (number > low) & (number < high)
            keep = inside | c.isNull()
        case "top_percent" | "bottom_percent":
            share = float(f.value) / 100
            cut = df.agg(F.percentile(number, 1 - share if f.rule == "top_percent" else share).alias("_cut"))
            passed = number >= F.col("_cut") if f.rule == "top_percent" else number <= F.col("_cut")
            return df.crossJoin(F.broadcast(cut)).filter(passed | c.isNull()).drop("_cut")  # one row
        case "equal" | "not_equal":
            same = F.coalesce(text_of(f.column, kind) == F.lit(f.value), F.lit(False))
            keep = same if f.rule == "equal" else ~same
        case "is_in" | "is_not_in":
            if f.value.endswith(".txt"):
                listed = df.sparkSession.read.text(f.value).select(F.trim("value").cast(kind).alias("_v")).filter("_v <> ''").distinct()
                return df.join(listed, c == listed["_v"], "left_semi" if f.rule == "is_in" else "left_anti")
            values = f.values()
            if len(values) > LITERALS:
                listed = df.sparkSession.createDataFrame([(v,) for v in values], f"_v {kind}")
                return df.join(listed, c == listed["_v"], "left_semi" if f.rule == "is_in" else "left_anti")
            inside = F.coalesce(c.isin(values), F.lit(False))
            keep = inside if f.rule == "is_in" else ~inside
        case "is_null":
            keep = c.isNull()
        case "is_not_null":
            keep = c.isNotNull()
        case "is_true":
            keep = c.eqNullSafe(True)
        case "is_false":
            keep = c.eqNullSafe(False)
        case "is_not_true":
            keep = ~c.eqNullSafe(True)
        case "is_not_false":
            keep = ~c.eqNullSafe(False)
    return df.filter(keep)


def apply_filters(df: DataFrame, filters) -> DataFrame:
    """All filters in order: percent rules see what the rules before them left."""
    for f in parse_filters(filters):
        df = apply_filter(df, f)
    return df


def filter_report(df: DataFrame, header: str = "vcrs_header") -> DataFrame:
    """One row: vcrss, unique (of one variant), merged (variants in the others), total variants."""
    n = F.regexp_count(F.col(header), F.lit(";")) + 1
    return df.agg(
        F.count("*").alias("number_of_vcrss"),
        F.count_if(n == 1).alias("number_of_unique_variants"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("number_of_merged_variants"),
        F.coalesce(F.sum(n), F.lit(0)).alias("number_of_variants_total"),
    )
