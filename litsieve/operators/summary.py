"""Counts and the pipeline audit table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, col: str, out: str = "value") -> DataFrame:
    """G1: counts per value, NULL excluded. Order with ``.orderBy(F.desc('n'), out)`` when shown."""
    return df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias(out)).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, col: str, out: str = "value") -> DataFrame:
    """The distinct non-NULL values, one row each (their number is the row count)."""
    return df.filter(F.col(col).isNotNull()).select(F.col(col).alias(out)).distinct()


def split_counts(df: DataFrame, matched: Column) -> DataFrame:
    """Total, matched and unmatched counts in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total_count"),
                  F.count_if(F.coalesce(matched, F.lit(False))).alias("matched_count"),
                  F.count_if(~F.coalesce(matched, F.lit(False))).alias("unmatched_count"))


def audit_table(records: list[DataFrame]) -> DataFrame:
    """A1: union of per-stage audit frames; missing keys become NULL columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), records)
