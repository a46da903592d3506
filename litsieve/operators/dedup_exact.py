"""Exact de-duplication.

Keep-first / keep-last are hash aggregates (min / max id) over a fixed-size digest of the
normalised keys, followed by a semi join on the unique id; not windows. The aggregate is
combined map-side, so a key that holds a third of all rows sends one row per map task through
the shuffle instead of landing whole in one window task, and long text keys are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from litsieve.constants import KEEP_OPTIONS
from litsieve.functions.text import norm_key, percent

MISSING_OPTIONS = ("empty", "equal", "distinct")


@dataclass(frozen=True)
class ExactConfig:
    subset: tuple[str, ...] = ("Title", "DOI", "Abstract")
    keep: str = "first"
    case_sensitive: bool = False
    # 'empty': missing == '' (the reference's "ignore NA"); 'equal': missing values equal each other
    # only; 'distinct': a row whose key columns are all missing is never a duplicate.
    missing: str = "empty"
    order_by: tuple[str, ...] = ("paper_id",)
    id_col: str = "paper_id"


def _check(cfg: ExactConfig) -> None:
    if cfg.keep not in KEEP_OPTIONS:
        raise ValueError(f"keep must be one of {KEEP_OPTIONS}")
    if cfg.missing not in MISSING_OPTIONS:
        raise ValueError(f"missing must be one of {MISSING_OPTIONS}")


def key_columns(df: DataFrame, cfg: ExactConfig) -> list[Column]:
    """Derived key columns; the originals stay untouched."""
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = []
    for i, name in enumerate(cfg.subset):
        k = F.col(name)
        if isinstance(types[name], StringType):
            if cfg.missing == "empty":
                k = F.coalesce(k, F.lit(""))
            if not cfg.case_sensitive:
                k = norm_key(k)
        keys.append(k.alias(f"__k{i}"))
    if cfg.missing == "distinct":
        all_missing = F.lit(True)
        for name in cfg.subset:
            all_missing = all_missing & F.col(name).isNull()
        keys.append(F.when(all_missing, F.col(cfg.id_col)).alias("__kmiss"))
    return keys


def key_digest(df: DataFrame, cfg: ExactConfig) -> Column:
    """One fixed-size group key: SHA-256 of the JSON array of the normalised key values.

    Grouping and shuffling 32 bytes instead of whole texts; JSON keeps NULL distinct from ''
    and the separators unambiguous.
    """
    keys = [k.cast("string") for k in key_columns(df, cfg)]
    return F.sha2(F.to_json(F.array(*keys)), 256)


def _by_id_only(cfg: ExactConfig) -> bool:
    return tuple(cfg.order_by) == (cfg.id_col,)


def kept_ids(df: DataFrame, cfg: ExactConfig) -> DataFrame:
    """Ids of the rows the keep rule retains (one hash aggregate over (digest, id))."""
    _check(cfg)
    keyed = df.select(key_digest(df, cfg).alias("__h"), F.col(cfg.id_col),
                      F.struct(*[F.col(c) for c in cfg.order_by], F.col(cfg.id_col)).alias("__ord"))
    grouped = keyed.groupBy("__h")
    if cfg.keep == "none":
        return grouped.agg(F.count(F.lit(1)).alias("__n"), F.min(cfg.id_col).alias(cfg.id_col)) \
            .filter("__n = 1").select(cfg.id_col)
    if _by_id_only(cfg):  # plain min/max of a long: hash aggregate, combined map-side
        agg = F.min(cfg.id_col) if cfg.keep == "first" else F.max(cfg.id_col)
    else:
        pick = F.min_by if cfg.keep == "first" else F.max_by
        agg = pick(F.col(cfg.id_col), F.col("__ord"))
    return grouped.agg(agg.alias(cfg.id_col))


def exact_dedup(df: DataFrame, cfg: ExactConfig = ExactConfig()) -> DataFrame:
    """Rows kept under the keep rule, original columns only.

    Plan: hash aggregate of (key digest, id) -> kept ids -> semi join on the unique id. A key
    holding a third of all rows collapses map-side; the join key (id) is uniform.
    """
    return df.join(kept_ids(df, cfg), cfg.id_col, "left_semi")


def duplicate_rows(df: DataFrame, cfg: ExactConfig = ExactConfig()) -> DataFrame:
    """The rows the keep rule removes (anti join on the unique id, no key skew)."""
    return df.join(kept_ids(df, cfg), cfg.id_col, "left_anti")


def duplicate_flags(df: DataFrame, cfg: ExactConfig = ExactConfig()) -> DataFrame:
    """Every row with ``dup_group`` (smallest id of its key), ``group_size`` and ``is_duplicate``.

    Per-key facts come from one aggregate over (digest, id); they are attached to the narrow
    (id, digest) table, where a hot digest only moves 40-byte rows (and AQE splits the skewed
    partition), and then joined to the full rows on the uniform id.
    """
    _check(cfg)
    order = F.struct(*[F.col(c) for c in cfg.order_by], F.col(cfg.id_col))
    ids = df.select(F.col(cfg.id_col), key_digest(df, cfg).alias("__h"), order.alias("__ord"))
    per_key = ids.groupBy("__h").agg(
        F.min(cfg.id_col).alias("dup_group"),
        F.count(F.lit(1)).alias("group_size"),
        (F.min(cfg.id_col) if _by_id_only(cfg) else F.min_by(F.col(cfg.id_col), F.col("__ord"))).alias("__first"),
        (F.max(cfg.id_col) if _by_id_only(cfg) else F.max_by(F.col(cfg.id_col), F.col("__ord"))).alias("__last"),
    )
    if cfg.keep == "first":
        dup = F.col(cfg.id_col) != F.col("__first")
    elif cfg.keep == "last":
        dup = F.col(cfg.id_col) != F.col("__last")
    else:
        dup = F.col("group_size") > 1
    facts = ids.join(per_key, "__h").select(cfg.id_col, "dup_group", "group_size", dup.alias("is_duplicate"))
    return df.join(facts, cfg.id_col)


def dedup_audit(flags: DataFrame, method: str) -> DataFrame:
    """Original / remaining / removed counts and percent from a flagged frame, one pass."""
    return flags.agg(
        F.count(F.lit(1)).alias("original_count"),
        F.count_if(~F.col("is_duplicate")).alias("remaining_count"),
        F.count_if(F.col("is_duplicate")).alias("removed_count"),
    ).select(
        F.lit(2).alias("stage"), F.lit("Duplicate removal").alias("action"), F.lit(method).alias("method"),
        "original_count", "remaining_count", "removed_count",
        percent("removed_count", "original_count").alias("removed_pct"),
    )
