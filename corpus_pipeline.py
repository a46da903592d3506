"""Corpus pipeline: language ID, SimHash near-dedup, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the
shared folder and hands the written table to the next stage. All but the last return the documents' columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm import langid, mixing, packing, simhash
from litsieve.session import ensure_checkpoint_dir, read_table

#: SQL cannot express a trained network, XXH64 or the seeded tree; tests compare with brute force.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without any letter, and with no convincing language, go.

    A null or empty text has no letter. What convinces is set from all labelled texts outside the held-out third;
    without any label only texts without letters go. Repeated rows are judged alike; an empty table stays empty."""
    labelled = docs.select("doc_id", "text", "lang")
    net, langs = langid.fit(labelled)
    if not langs:  # nothing to learn from, so nothing can be rejected but texts without letters
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    least = langid.rejection_bound(labelled, net, langs)
    told = langid.identify(docs, net, langs, ("__lang_pred", "__lang_score"))
    return told.where((F.col("__lang_pred") != langid.UNDETERMINED) & (F.col("__lang_score") >= least)).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the smallest doc_id's. Texts without words, null ones
    included, are one group; of repeated rows one stays; an empty table stays empty."""
    return simhash.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as it is drawn, in the order of the output shards. Null and empty
    texts weigh nothing; a null source is one of the sources, the last; an empty table stays empty."""
    return mixing.mix(docs, shard_col="__shard").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture in sequences of at most 2048 tokens; a document drawn twice is packed twice. Null and
    empty texts are the end token alone; an empty table gives no pieces."""
    return packing.pack_documents(docs)


STAGES = [("language", language_stage), ("near_dedup", dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
