"""Stage composition (A1, A2) and the flagship query.

``run_screening`` chains the screening stages lazily: de-duplication -> primary categories ->
secondary categories -> dimension tags. As in the reference, each stage continues with the
rows the previous stage matched; unlike it (B13), every stage's unmatched rows are kept,
tagged with the stage number. The audit table is built from per-stage Spark aggregates.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.constants import DEFAULT_CLUSTERS, DEFAULT_MIN_SCORE
from litsieve.functions.lexicon import Lexicon
from litsieve.functions.text import search_text
from litsieve.operators import categorize as cz
from litsieve.operators import classify as cl
from litsieve.operators import dedup_exact as dx
from litsieve.operators import dedup_near as dn
from litsieve.operators import vectors as vc
from litsieve.operators.summary import audit_table
from litsieve.plans import lexicons as lx
from litsieve.schema import papers_view, validate_columns
from litsieve.session import read_table
from litsieve.sinks.files import write_parquet

DEDUP_METHODS = {
    "exact": "Strict exact matching",
    "fuzzy": "Fuzzy matching ({threshold:g}%)",
    "near": "Near (MinHash 0.85)",
    "combined": "Combined (MinHash + Fuzzy)",
}


PRIMARY_METHODS = {
    "phrases": "Standalone Exact-Match",
    "pairs": "Configurable Keyword Matching",
    "keywords": "Configurable Keyword Matching",
    "seeds": "BERT Semantic Matching",
    "clusters": "BERT Semantic Matching",
}


@dataclass(frozen=True)
class MlStage:
    """Classification of the processed papers into the column ``dimension``: ``classify(papers, dimension)``
    returns them with that column; ``option`` names the choice in the audit table."""
    dimension: str
    option: str
    classify: Callable[[DataFrame, str], DataFrame]


def trained_forest(train: DataFrame, text_cols, label_col: str, dimension: str, predict_cols, **fit) -> MlStage:
    """'Train new model': a forest fitted on ``train``, applied to every processed paper."""
    def run(papers, out):
        return cl.predict(cl.fit_forest(train, text_cols, label_col, **fit), papers, predict_cols, out)
    return MlStage(dimension, "Train new model", run)


def saved_forest(root: str, dimension: str, predict_cols) -> MlStage:
    """'Use pre-trained model': the forest saved for ``dimension`` under ``root``."""
    return MlStage(dimension, "Use pre-trained model",
                   lambda papers, out: cl.predict(cl.load_model(root, dimension), papers, predict_cols, out))


def label_overlap(dimension: str, candidates: dict[str, str], text_cols) -> MlStage:
    """'Use transformer model': the zero-shot scorer by word overlap with the labels' descriptions."""
    return MlStage(dimension, "Use transformer model",
                   lambda papers, out: cl.zero_shot_overlap(papers, text_cols, candidates, out))


@dataclass
class ScreeningConfig:
    dedup: str = "combined"
    dedup_columns: tuple[str, ...] = ("Title", "DOI", "Abstract")
    keep: str = "first"
    fuzzy_threshold: float = 90
    text_columns: tuple[str, ...] = ("Title", "Abstract")
    primary: str = "phrases"           # a key of PRIMARY_METHODS
    scored: Lexicon = lx.SCORED        # 'keywords'
    min_score: float = DEFAULT_MIN_SCORE
    strategy: str = "best"
    fuzzy_keywords: bool = False
    seed_terms: tuple[str, ...] = ()   # 'seeds': one seed vector a term
    clusters: int = DEFAULT_CLUSTERS   # 'clusters'
    ml: MlStage | None = None
    core: Lexicon = lx.CORE
    additional: Lexicon = lx.ADDITIONAL
    secondary: Lexicon = lx.SECONDARY
    dimensions: dict = field(default_factory=lambda: dict(lx.DIMENSION_LEXICONS))


@dataclass
class ScreeningResult:
    processed: DataFrame
    unmatched: DataFrame
    summary: DataFrame
    stages: dict


def _dedup(papers: DataFrame, cfg: ScreeningConfig) -> DataFrame:
    cols = cfg.dedup_columns
    if cfg.dedup == "exact":
        return dx.exact_dedup(papers, dx.ExactConfig(subset=cols, keep=cfg.keep))
    if cfg.dedup == "fuzzy":
        return dn.fuzzy_dedup(papers, dn.FuzzyConfig(columns=cols, threshold=cfg.fuzzy_threshold, keep=cfg.keep))
    if cfg.dedup == "near":
        return dn.near_dedup(papers, dn.NearConfig(text_cols=cols, keep=cfg.keep))
    if cfg.dedup == "combined":
        return dn.combined_dedup(papers, dn.CombinedConfig(columns=cols, keep=cfg.keep,
                                                          fuzzy_threshold=cfg.fuzzy_threshold))
    raise ValueError(f"unknown de-duplication method {cfg.dedup!r}")


def _primary(papers: DataFrame, cfg: ScreeningConfig) -> DataFrame:
    """Stage 3 by the chosen method; always adds ``primary_category``."""
    if cfg.primary == "phrases":
        return cz.phrase_labels(papers, cfg.text_columns, cfg.core, cfg.additional)
    if cfg.primary == "pairs":
        return cz.paired_labels(papers, cfg.text_columns, cfg.core, cfg.additional)
    if cfg.primary == "keywords":
        return cz.scored_keywords(papers, cfg.text_columns, cfg.scored, cfg.min_score, cfg.strategy, fuzzy=cfg.fuzzy_keywords)
    text = papers.withColumn("__text", search_text(cfg.text_columns))
    if cfg.primary == "clusters":
        vectors = vc.embed(text, "__text", "__vector")
        return vc.kmeans_cosine(vectors, "__vector", k=cfg.clusters, out_col="primary_category").drop("__text", "__vector")
    if cfg.primary == "seeds":
        return vc.assign_to_terms(text, "__text", cfg.seed_terms, out_col="primary_category").drop("__text")
    raise ValueError(f"unknown primary method {cfg.primary!r}")


def _split_audit(df: DataFrame, matched, stage: int, action: str, method: str | None, categories) -> DataFrame:
    m = F.coalesce(matched, F.lit(False))
    return df.agg(F.count_if(m).alias("matched_count"), F.count_if(~m).alias("unmatched_count"),
                  categories.alias("categories_created")).select(
        F.lit(stage).alias("stage"), F.lit(action).alias("action"), F.lit(method).cast("string").alias("method"),
        "matched_count", "unmatched_count", F.col("categories_created").cast("long").alias("categories_created"))


MANIFEST_SCHEMA = "stage int, digest string, n_rows long"


class SavedStages:
    """Stage tables under ``root``, each with a manifest row (digest, row count) written after its table.

    A stage's digest covers the input's rows and the settings of this and every earlier stage. A stage whose
    manifest carries its digest is read back; any other is run, written and only then entered, so a run that
    ends half-way goes on after its last complete stage. Tables lie in folders named by their digest: another
    input or other settings never overwrite what a running job reads.
    """

    def __init__(self, papers: DataFrame, root: str):
        self.spark, self.root, self.resumed = papers.sparkSession, root, []
        # the sum of row hashes does not depend on the order of the rows; equal rows count as often as they stand
        cols = [x for c in papers.columns for x in (F.col(c), F.col(c).isNull())]
        whole = [F.sum(F.xxhash64(F.lit(salt), *cols).cast("decimal(20,0)")) for salt in ("a", "b")]
        self.digest = repr((papers.schema.simpleString(), tuple(papers.agg(F.count(F.lit(1)), *whole).first())))

    def _manifest(self, path: str):
        try:
            return self.spark.read.schema(MANIFEST_SCHEMA).json(path).first()
        except AnalysisException:  # no such folder: the stage has never been completed
            return None

    def keep(self, stage: int, settings: tuple, build: Callable[[], DataFrame]) -> DataFrame:
        self.digest = hashlib.sha256(repr((self.digest, stage, settings)).encode()).hexdigest()
        folder = os.path.join(self.root, f"stage={stage}", self.digest[:32])
        table, manifest = os.path.join(folder, "processed"), os.path.join(folder, "manifest")
        entry = self._manifest(manifest)
        if entry is None or entry["digest"] != self.digest:
            write_parquet(build(), table)
            rows = self.spark.read.parquet(table).count()
            self.spark.createDataFrame([(stage, self.digest, rows)], MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").json(manifest)
            return self.spark.read.parquet(table)
        saved = self.spark.read.parquet(table)
        if saved.count() != entry["n_rows"]:
            raise ValueError(f"stage {stage} under {folder} has lost rows since it was saved")
        self.resumed.append(stage)
        return saved


def run_screening(papers: DataFrame, cfg: ScreeningConfig = ScreeningConfig(), root: str | None = None,
                  last_stage: int = 5) -> ScreeningResult | None:
    """A2: all stages in order; each later stage reads the earlier one's matched rows.

    With ``root`` (a shared folder) the tables of stages 2 to 5 are saved there and a later run with the same
    input and settings goes on after the last complete stage; the result's ``stages["resumed"]`` names those read
    back. ``last_stage`` ends a saved run early, without a result. The ML stage is a function and is run anew.
    """
    if root is None and last_stage != 5:
        raise ValueError("a run that ends early needs a folder to save its stages in")
    validate_columns(papers, ["paper_id", *cfg.dedup_columns, *cfg.text_columns])  # B19: check inputs up front
    # the de-duplicated table feeds every later stage and the audit: keep it (memory + disk)
    saved = SavedStages(papers, root) if root else None

    def stage(number, settings, build):
        return saved.keep(number, settings, build) if saved else build()

    unique = stage(2, (cfg.dedup, cfg.dedup_columns, cfg.keep, cfg.fuzzy_threshold), lambda: _dedup(papers, cfg))
    if last_stage == 2:
        return None
    if not saved:
        unique = unique.persist(StorageLevel.MEMORY_AND_DISK)
    audits = [dn.dedup_counts(papers, unique, DEDUP_METHODS[cfg.dedup].format(threshold=cfg.fuzzy_threshold))]

    primary = stage(3, (cfg.text_columns, cfg.primary, cfg.scored, cfg.min_score, cfg.strategy, cfg.fuzzy_keywords,
                        cfg.seed_terms, cfg.clusters, cfg.core, cfg.additional), lambda: _primary(unique, cfg))
    if last_stage == 3:
        return None
    p_match, p_un = cz.split_matched(primary, "primary_category")
    is_cat = F.col("primary_category") != F.lit(cz.UNCATEGORIZED)
    audits.append(_split_audit(primary, is_cat, 3, "Primary categorization", PRIMARY_METHODS[cfg.primary],
                               F.count_distinct(F.when(is_cat, F.col("primary_category")))))

    text_cols = [f.name for f in papers.schema.fields if f.dataType.simpleString() == "string"]
    secondary = stage(4, (cfg.secondary,), lambda: cz.substring_category(p_match, cfg.secondary, text_cols=text_cols))
    if last_stage == 4:
        return None
    s_match, s_un = cz.split_matched(secondary, "secondary_category", None)
    audits.append(_split_audit(secondary, F.col("secondary_category").isNotNull(), 4, "Secondary categorization",
                               None, F.lit(len(cfg.secondary.entries))))

    final = stage(5, tuple(cfg.dimensions.items()), lambda: cz.tag_dimensions(s_match, cfg.dimensions, text_cols=text_cols))
    audits.append(papers.sparkSession.createDataFrame(
        [(5, "Manual analysis", ", ".join(cfg.dimensions))], "stage int, action string, dimensions string"))

    if cfg.ml:
        final = cfg.ml.classify(final, cfg.ml.dimension)
        audits.append(papers.sparkSession.createDataFrame(
            [(5, "ML classification", cfg.ml.dimension, cfg.ml.option)],
            "stage int, action string, dimension string, method string"))

    unmatched = (p_un.withColumn("unmatched_stage", F.lit(3))
                 .unionByName(s_un.withColumn("unmatched_stage", F.lit(4)), allowMissingColumns=True))
    return ScreeningResult(processed=final, unmatched=unmatched, summary=audit_table(audits),
                          stages={"dedup": unique, "primary": primary, "secondary": secondary,
                                  "resumed": saved.resumed if saved else []})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper view -> exact de-dup on Title/DOI/Abstract (keep first) -> phrase labels -> counts."""
    papers = papers_view(read_table(spark, sf_dir, "documents"))
    unique = dx.exact_dedup(papers, dx.ExactConfig(subset=("Title", "DOI", "Abstract")))
    labelled = cz.phrase_labels(unique, ("Title", "Abstract"), lx.CORE, lx.ADDITIONAL)
    return cz.label_counts(labelled)
