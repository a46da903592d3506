"""Streaming screening of landed payloads.

The reference has no streaming state, watermark or window; its per-row stages (search text,
phrase / substring / dimension tagging) are stateless projections, so they apply unchanged to a
streaming DataFrame. This module wires them to Structured Streaming: a file stream of landed
paper rows (Parquet or CSV, fixed schema), tagged per micro-batch, written with exactly-once
file-sink semantics and a checkpoint location on the shared file system.

De-duplication is not streamed: greedy survivors depend on all earlier rows, so it runs as a
batch job over the landed table (see ``litsieve.operators.dedup_near``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from litsieve.functions.lexicon import Lexicon
from litsieve.operators import categorize as cz
from litsieve.schema import PAPER_SCHEMA


def read_paper_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int = 100) -> DataFrame:
    """Landed paper rows as a stream (schema fixed up front, as streaming sources require)."""
    reader = spark.readStream.schema(PAPER_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(fmt).load(path)


def tag_stream(stream: DataFrame, core: Lexicon, additional: Lexicon | None = None, secondary: Lexicon | None = None,
               dimensions: dict[str, Lexicon] | None = None, text_cols=("Title", "Abstract")) -> DataFrame:
    """C1 (+ C4, C5 when given) on a streaming frame: pure projections, no state."""
    text_only = [c for c in stream.columns if c != "paper_id"]
    out = cz.phrase_labels(stream, list(text_cols), core, additional)
    if secondary is not None:
        out = cz.substring_category(out, secondary, text_cols=text_only)
    if dimensions:
        out = cz.tag_dimensions(out, dimensions, text_cols=text_only)
    return out


def start_screening(stream: DataFrame, out_path: str, checkpoint: str, trigger_once: bool = False,
                    partition_col: str | None = None) -> StreamingQuery:
    """Append tagged rows to Parquet; the checkpoint folder must be on the shared file system."""
    w = stream.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    if partition_col:
        w = w.partitionBy(partition_col)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()
