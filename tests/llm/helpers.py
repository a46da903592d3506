"""Frames that every operator must survive."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} des{i % 13}" for i in range(30_000))


def odd_documents(spark: SparkSession, more: str = "size long, fp string, shard int, score string, _row int") -> DataFrame:
    """Nulls in any column, empty and long texts, repeated rows, ties, and extra columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a"), (2, "The quick brown fox jumps over the lazy dog", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog", "en", "a"), (3, None, "en", "a"), (4, "", None, None), (5, "  \t\n ", "de", "b"),
        (6, LONG, "en", None), (7, "one", "fr", "b"), (None, "no id at all here", "en", "c"), (None, None, None, None),
        (8, "two words", None, "c"), (9, "12345 !!", "de", "c"), (10, "Das ist ein Haus und das ist ein Baum", "de", "b"), (11, "é è ü   x", "fr", "Z"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOC_SCHEMA)
    for name, kind in (c.split() for c in more.split(", ")):
        df = df.withColumn(name, F.lit("7").cast(kind))
    return df


def empty_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOC_SCHEMA)


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]
