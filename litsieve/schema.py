"""Paper table: the one data model every stage reads and writes.

``papers_view`` derives it from the driver's ``documents`` table with whole texts:
the first line is the title, the rest of the text is the abstract (NULL for one-line
documents), DOI and year come from the text's md5, so copies of a text share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

PAPER_COLUMNS = ["Title", "Abstract", "Year", "DOI", "Source"]

PAPER_SCHEMA = StructType(
    [StructField("paper_id", LongType(), False)]
    + [StructField(c, StringType(), True) for c in PAPER_COLUMNS]
)


def papers_view(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, lang, source, n_chars) -> paper table (+ lang)."""
    text = F.col("text")
    newline = F.instr(text, "\n")
    digest = F.md5(text)
    return documents.select(
        F.col("doc_id").cast("bigint").alias("paper_id"),
        F.substring_index(text, "\n", 1).alias("Title"),
        F.when(newline > 0, F.expr("substr(text, instr(text, '\\n') + 1)")).alias("Abstract"),
        (F.lit(2000) + F.conv(F.substring(digest, 10, 1), 16, 10).cast("int")).cast("string").alias("Year"),
        F.when(F.substring(digest, 9, 1).isin("0", "1"), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("10.5555/"), F.substring(digest, 1, 8))).alias("DOI"),
        F.col("source").alias("Source"),
        F.col("lang"),
    )


# DuckDB twin of ``papers_view`` used inside oracle SQL (same columns, same rules).
PAPERS_SQL = """(
  SELECT doc_id AS paper_id,
         split_part(text, chr(10), 1) AS "Title",
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) END AS "Abstract",
         CAST(2000 + ('0x' || substr(md5(text), 10, 1))::INTEGER AS VARCHAR) AS "Year",
         CASE WHEN substr(md5(text), 9, 1) IN ('0', '1') THEN NULL
              ELSE '10.5555/' || substr(md5(text), 1, 8) END AS "DOI",
         source AS "Source",
         lang
  FROM documents
)"""


def validate_columns(df: DataFrame, required) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
