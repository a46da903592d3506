"""Small helpers over column references and schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    """Names of the string-typed columns, in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def pick_columns(df: DataFrame, preferred: list[str], fallback_n: int) -> list[str]:
    """The preferred columns when all exist, else the first ``fallback_n`` columns."""
    if set(preferred).issubset(df.columns):
        return list(preferred)
    return df.columns[:fallback_n]


def present_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Those of ``wanted`` that exist, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def export_columns(df: DataFrame) -> list[str]:
    """P4 for export: Title, Abstract, primary_category, secondary_category if present, else first 5."""
    cols = present_columns(df, ["Title", "Abstract", "primary_category", "secondary_category"])
    return cols or df.columns[:5]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as column ``name``, computed once a row: Spark copies a plain projection's expression into
    each filter above it, once for each time that names the column."""
    return df.withColumn(name, F.explode(F.array(value)))
