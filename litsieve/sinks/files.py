"""Sinks (K1-K7): CSV / Parquet exports, per-category partitions, stage checkpoints, models.

All writers are distributed Spark writes into a folder; nothing is gathered on the driver.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.constants import NAME_MAX_LENGTH, UNCATEGORIZED, UNSAFE_NAME_CHARS
from litsieve.functions.columns import export_columns, present_columns



def export_key(c: Column) -> Column:
    """K4: partition-safe name: ``\\ / * ? : [ ]`` -> '_', cut to 31 characters."""
    return F.substring(F.regexp_replace(c, UNSAFE_NAME_CHARS, "_"), 1, NAME_MAX_LENGTH)


def write_csv(df: DataFrame, path: str, columns=None, single_file: bool = False, mode: str = "overwrite") -> str:
    """K1: header row, chosen columns (default: P4 export columns), no index column."""
    cols = present_columns(df, list(columns)) if columns else export_columns(df)
    out = df.select(*cols)
    if single_file:
        out = out.coalesce(1)
    # keep outer blanks (the CSV writer trims them by default) and write '' as a quoted empty field,
    # so NULL and '' stay distinct after a round trip
    (out.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", False)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     # the writer's own formats stop at milliseconds
     .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
     .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
     .option("emptyValue", '""').csv(path))
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def export_result(root: str, processed: DataFrame, unmatched: DataFrame | None, summary: DataFrame | None,
                  columns=None, formats=("parquet", "csv")) -> dict[str, str]:
    """K2/K7: processed, unmatched (when present) and the pipeline summary, in each format. What follows a Parquet
    copy is written from it, so that the papers are not computed anew for each format."""
    written = {}
    cols = list(columns) if columns else export_columns(processed)
    parts = {"processed": processed.select(*present_columns(processed, cols))}
    if unmatched is not None:
        ucols = present_columns(unmatched, cols) or unmatched.columns  # P7: only columns that exist there
        parts["unmatched"] = unmatched.select(*ucols)
    if summary is not None:
        parts["summary"] = summary
    for name, frame in parts.items():
        for fmt in formats:
            path = os.path.join(root, fmt, name)
            if fmt == "parquet":
                write_parquet(frame, path)
                frame = frame.sparkSession.read.schema(frame.schema).parquet(path)
            else:
                write_csv(frame, path, columns=frame.columns)
            written[f"{fmt}/{name}"] = path
    return written


def write_by_category(df: DataFrame, path: str, category_col: str = "primary_category",
                      uncategorized: str = UNCATEGORIZED, fmt: str = "parquet", rows_a_file: int = 1_000_000) -> DataFrame:
    """K3: one output partition per category (multi-labels stay one key), plus the count table.

    A category of n rows is spread over ceil(n / rows_a_file) salts and each (category, salt) is written by one
    task, so small categories are one file and a large one is never one task; a file holds ``rows_a_file`` rows
    at most. The salt is a hash of the row, the same when a lost task is run again.

    Returns the summary counts (G1). Categories whose sanitised keys coincide get a digest suffix each.
    """
    name = F.coalesce(F.col(category_col), F.lit(uncategorized))
    names = (df.groupBy(name.alias("__name")).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_a_file)).alias("__files")).withColumn("__key", export_key(F.col("__name")))
             .withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("__key"))))
    names = names.select("__name", "__files", F.when(F.col("__n") > 1, F.concat("__key", F.lit("_"), F.substring(F.md5("__name"), 1, 8)))
                         .otherwise(F.col("__key")).alias("category_key"))
    keyed = df.withColumn("__name", name).join(names, "__name").drop("__name")
    salted = keyed.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.col("__files")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (salted.repartition(parts, "category_key", "__salt").drop("__salt", "__files")
     .write.mode("overwrite").option("maxRecordsPerFile", rows_a_file)
     .partitionBy("category_key").format(fmt).save(path))
    return keyed.groupBy(category_col).agg(F.count(F.lit(1)).alias("n_papers"))


def save_stage(root: str, stage: int, processed: DataFrame, unmatched: DataFrame | None = None) -> dict[str, str]:
    """K5: stage checkpoint of processed and unmatched tables (Parquet)."""
    out = {"processed": write_parquet(processed, os.path.join(root, f"stage={stage}", "processed"))}
    if unmatched is not None:
        out["unmatched"] = write_parquet(unmatched, os.path.join(root, f"stage={stage}", "unmatched"))
    return out


_DIM_NAME = re.compile(r"^[a-z0-9_]+$")


def model_path(root: str, dimension: str) -> str:
    """K6: model folder for a dimension; the name is validated, never used as a raw path."""
    name = dimension.strip().lower()
    if not _DIM_NAME.match(name):
        raise ValueError(f"dimension name {dimension!r} must match [a-z0-9_]+")
    return os.path.join(root, f"{name}_classifier")
