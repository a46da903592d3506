"""Near, fuzzy and combined de-duplication.

All three follow one plan:
1. collapse rows with identical match data to one representative (the first row in scan
   order); identical rows are twins in the similarity graph, so the greedy scan over
   representatives gives the same survivors, and a key held by a third of all rows becomes a
   single row before any pair is formed;
2. build the similarity edges between representatives with a lossless join (setsim / fuzzy);
3. run the greedy survivors rounds; keep the representatives that survive.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.constants import COMBINED_FUZZY_THRESHOLD, FUZZY_PRESETS, NEAR_THRESHOLD
from litsieve.functions.edits import Words, composite_may, composite_of, token_set_may, token_set_of
from litsieve.functions.similarity import max_edits
from litsieve.functions.text import match_key, percent, search_text, word_set
from litsieve.operators.bins import among_bins, repeated_bins
from litsieve.operators.fuzzy import edit_candidates, edit_keys, edit_pairs, rows_with_neighbours, score_pairs, verify_edit_pairs
from litsieve.operators.setsim import (PAIRS_A_GROUP, jaccard_pairs, jaccard_sets, lsh_banded, lsh_candidates, lsh_pairs,
                                       pair_groups, prefix_candidates, prefix_rows, prefix_sets, verify_jaccard)
from litsieve.operators.survivors import greedy_removed, seeded_removed
from litsieve.session import cut_lineage

PRESETS = FUZZY_PRESETS


@dataclass(frozen=True)
class NearConfig:
    text_cols: tuple[str, ...] = ("Title", "Abstract")
    threshold: float = NEAR_THRESHOLD
    method: str = "exact"  # 'exact' prefix-filter join or 'lsh'
    bands: int = 16
    rows: int = 8
    keep: str = "first"
    id_col: str = "paper_id"


@dataclass(frozen=True)
class FuzzyConfig:
    columns: tuple[str, ...] = ("Title", "DOI", "Abstract")
    threshold: float = 90
    keep: str = "first"
    id_col: str = "paper_id"


@dataclass(frozen=True)
class CombinedConfig:
    columns: tuple[str, ...] = ("Title", "DOI", "Abstract")
    near_threshold: float = NEAR_THRESHOLD
    fuzzy_threshold: float = COMBINED_FUZZY_THRESHOLD
    keep: str = "first"
    id_col: str = "paper_id"
    scorer: str = "ratio"  # 'ratio' (edit distance), 'token_set' (D14) or 'composite' (best of the scorers, D13)
    mode: str = "verified"  # 'verified': near pairs checked by the scorer; 'sequential': near, then fuzzy de-dup


def _representatives(df: DataFrame, id_col: str, payload: dict[str, Column], group_key, matchable, keep: str) -> DataFrame:
    """One row per identical group: rep id (first in scan order), group size, payload.

    The payload (word set, cleaned key) is computed once per row and kept (memory + disk) for
    the two branches that read it; groups are formed on a SHA-256 digest of ``group_key()`` (a
    hash aggregate, combined map-side) and joined back on the unique id. Rows whose digest and id
    share their hash bins with no other row are groups of their own and take no part in that
    join, so their payload is not shuffled. ``group_key`` and ``matchable`` build expressions over
    the payload columns. Rows that cannot match anything stay singletons. The result is cut with a reliable checkpoint: the joins, the verification
    and the survivor rounds all read it.
    """
    m = matchable()
    key = F.when(m, group_key()).otherwise(F.concat(F.lit("\u0000"), F.col("id").cast("string")))
    base = df.select(F.col(id_col).alias("id"), *[c.alias(n) for n, c in payload.items()]) \
        .withColumn("__gk", F.sha2(key, 256)).persist(StorageLevel.MEMORY_AND_DISK)
    rep_id = F.min("id") if keep in ("first", "none") else F.max("id")
    by_key, by_id = (among_bins(repeated_bins(base, c)) for c in ("__gk", "id"))
    marked = base.withColumns({"__by_key": by_key("__gk"), "__by_id": by_id("id")})
    shared, alone = marked.filter("__by_key or __by_id"), marked.filter("not __by_key and not __by_id and id is not null")
    groups = (shared.select("id", "__gk").groupBy("__gk")
              .agg(rep_id.alias("id"), F.count(F.lit(1)).alias("group_size")))
    reps = shared.join(groups.select("id", "group_size"), "id") \
        .unionByName(alone.withColumn("group_size", F.lit(1).cast("long")))
    out = cut_lineage(reps.select("id", "group_size", m.alias("matchable"), *payload))
    base.unpersist()
    return out


def _survivors(df: DataFrame, reps: DataFrame, edges: DataFrame, keep: str, id_col: str) -> DataFrame:
    removed = greedy_removed(edges.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), keep)
    return _keep_reps(df, reps, removed, keep, id_col)


def _keep_reps(df: DataFrame, reps: DataFrame, removed: DataFrame, keep: str, id_col: str) -> DataFrame:
    kept = reps.join(removed, "id", "left_anti")
    if keep == "none":
        kept = kept.filter(F.col("group_size") == 1)
    return df.join(kept.select(F.col("id").alias(id_col)), id_col, "left_semi")


def _seeded(df: DataFrame, reps: DataFrame, keep: str, id_col: str, build) -> DataFrame:
    """Greedy de-dup through ``seeded_removed``; keep='last' scans negated ids (same order
    reversed). ``build(live)`` returns (prefix, key columns, candidates, verify) for the live
    representatives (columns id + payload)."""
    sign = 1 if keep == "first" else -1
    live = reps.filter("matchable").withColumn("id", F.col("id") * F.lit(sign))
    prefix, key_cols, candidates, verify = build(live)
    removed = seeded_removed(prefix, key_cols, candidates, verify)
    return _keep_reps(df, reps, removed.select((F.col("id") * F.lit(sign)).alias("id")), keep, id_col)


def _prefix_join(sets: DataFrame, t: float):
    """Prefix rows of the sets, and the candidates among those whose ids two tables of such rows hold."""
    prefixes = prefix_sets(sets, t)

    def candidates(pa: DataFrame, pb: DataFrame) -> DataFrame:
        def mark(name, rows):
            return rows.select("id").distinct().withColumn(name, F.lit(True))

        if pa is pb:
            return prefix_candidates(prefixes if pa is whole else prefixes.join(mark("m", pa).drop("m"), "id", "left_semi"), t)
        both = prefixes.join(mark("a", pa), "id", "left").join(mark("b", pb), "id", "left").fillna(False, ["a", "b"])
        return prefix_candidates(both.filter("a or b"), t)

    whole = prefix_rows(prefixes).persist(StorageLevel.MEMORY_AND_DISK)
    return whole, candidates


def near_items(df: DataFrame, cfg: NearConfig) -> DataFrame:
    return _representatives(df, cfg.id_col, {"words": word_set(search_text(cfg.text_cols))},
                            lambda: F.array_join(F.array_sort(F.col("words")), " "),
                            lambda: F.size(F.col("words")) > 0, cfg.keep)


def near_pairs(df: DataFrame, cfg: NearConfig = NearConfig()) -> DataFrame:
    """D11 (or D10+verify): representative pairs with word Jaccard >= threshold."""
    reps = near_items(df, cfg).filter("matchable")
    if cfg.method == "lsh":
        return lsh_pairs(reps, cfg.threshold, cfg.bands, cfg.rows)
    return jaccard_pairs(reps, cfg.threshold)


def near_dedup(df: DataFrame, cfg: NearConfig = NearConfig()) -> DataFrame:
    """Keep the earliest row of every near-duplicate run (greedy), drop the rest."""
    reps = near_items(df, cfg)  # checkpointed: feeds the join, the verification and the survivors
    if cfg.keep == "none":
        live = reps.filter("matchable")
        pairs = lsh_pairs(live, cfg.threshold, cfg.bands, cfg.rows) if cfg.method == "lsh" \
            else jaccard_pairs(live, cfg.threshold)
        return _survivors(df, reps, pairs, cfg.keep, cfg.id_col)
    t = cfg.threshold

    def build(live):
        sets = jaccard_sets(live)
        verify = (lambda c: verify_jaccard(c, sets, t))
        if cfg.method == "lsh":
            banded = lsh_banded(sets, cfg.bands, cfg.rows).persist(StorageLevel.MEMORY_AND_DISK)
            return banded, ["band", "bucket"], lsh_candidates, verify
        prefix, candidates = _prefix_join(sets, t)
        return prefix, ["w"], candidates, verify
    return _seeded(df, reps, cfg.keep, cfg.id_col, build)


def fuzzy_key(cols) -> Column:
    """P1 + P2: cleaned combined key of the selected columns."""
    return match_key(search_text(cols))


def fuzzy_items(df: DataFrame, cfg: FuzzyConfig) -> DataFrame:
    return _representatives(df, cfg.id_col, {"key": fuzzy_key(cfg.columns)}, lambda: F.col("key"),
                            lambda: F.length(F.col("key")) > 0, cfg.keep)


def fuzzy_pairs(df: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """Representative pairs with edit ratio >= threshold (0-100)."""
    return edit_pairs(fuzzy_items(df, cfg).filter("matchable"), cfg.threshold)


def fuzzy_dedup(df: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """Greedy fuzzy de-duplication with keep first / last / none."""
    reps = fuzzy_items(df, cfg)
    live = reps.filter("matchable")
    if cfg.keep == "none":
        return _keep_reps(df, reps, rows_with_neighbours(live, cfg.threshold), cfg.keep, cfg.id_col)
    return _survivors(df, reps, edit_pairs(live, cfg.threshold), cfg.keep, cfg.id_col)


def _combined_reps(df: DataFrame, cfg: CombinedConfig) -> DataFrame:
    return _representatives(
        df, cfg.id_col, {"words": word_set(search_text(cfg.columns[:1])), "key": fuzzy_key(cfg.columns)},
        lambda: F.concat_ws("\u0001", F.array_join(F.array_sort(F.col("words")), " "), F.col("key")),
        lambda: (F.size(F.col("words")) > 0) & (F.length(F.col("key")) > 0), cfg.keep)


def _combined_verify(cand: DataFrame, live: DataFrame, cfg: CombinedConfig) -> DataFrame:
    """Near pairs whose keys also reach the fuzzy threshold; lengths that rule it out go before any key is attached."""
    near = verify_jaccard(cand, jaccard_sets(live), cfg.near_threshold)
    keys = live.select("id", "key")
    if cfg.scorer == "ratio":
        sizes = live.select("id", F.length("key").alias("L"))
        near = near.join(sizes.withColumnsRenamed({"id": "id_a", "L": "len_a"}), "id_a") \
            .join(sizes.withColumnsRenamed({"id": "id_b", "L": "len_b"}), "id_b")
        lmax = F.greatest("len_a", "len_b")
        near = near.filter(lmax - F.least("len_a", "len_b") <= max_edits(lmax, cfg.fuzzy_threshold)).select("id_a", "id_b", "jaccard")
        return verify_edit_pairs(near, keys, cfg.fuzzy_threshold)

    if cfg.scorer not in ("token_set", "composite"):
        raise ValueError("scorer must be 'ratio', 'token_set' or 'composite'")
    threshold = float(cfg.fuzzy_threshold)
    of, may = (composite_of, composite_may) if cfg.scorer == "composite" else (token_set_of, token_set_may)

    def high_enough(a: Words, b: Words) -> float | None:
        score = of(a, b, threshold)
        return score if score is not None and score >= threshold - 1e-9 else None

    return score_pairs(_that_may(near, keys, may, threshold), keys, Words.of, high_enough)


def _that_may(near: DataFrame, keys: DataFrame, may, threshold: float) -> DataFrame:
    """The pairs whose keys may reach the threshold by their words, lengths and segments. Papers of one title are pairs
    by the square of their number: their keys are sent once a group, and only the pairs that are left by pair."""
    pairs, held = pair_groups(near, keys, PAIRS_A_GROUP)
    columns = near.columns

    def left(key, pairs: pa.Table, held: pa.Table) -> pa.Table:
        known: dict[int, list[Words]] = {}
        for id_, text in zip(held.column("id").to_pylist(), held.column("key").to_pylist()):
            known.setdefault(id_, []).append(Words.of(text))
        good = [any(may(a, b, threshold) for a in known.get(x, ()) for b in known.get(y, ()))
                for x, y in zip(pairs.column("id_a").to_pylist(), pairs.column("id_b").to_pylist())]
        return pairs.select(columns).filter(pa.array(good, pa.bool_()))

    return pairs.cogroup(held).applyInArrow(left, near.schema)


def combined_pairs(df: DataFrame, cfg: CombinedConfig = CombinedConfig()):
    """D19 edges: near-duplicate candidates on the first column, verified by the fuzzy ratio
    on all selected columns (intent of the reference: MinHash finds, fuzzy verifies)."""
    reps = _combined_reps(df, cfg)
    live = reps.filter("matchable")
    if cfg.scorer == "ratio":
        # the whole keys tell papers apart far better than titles do, which many papers share
        cand = edit_candidates(edit_keys(live), cfg.fuzzy_threshold)
    else:
        cand = prefix_candidates(prefix_sets(jaccard_sets(live), cfg.near_threshold), cfg.near_threshold)
    return reps, _combined_verify(cand, live, cfg)


def combined_dedup(df: DataFrame, cfg: CombinedConfig = CombinedConfig()) -> DataFrame:
    """Greedy de-duplication over the verified pairs, or (mode 'sequential') near de-dup of the first
    column followed by fuzzy de-dup of all selected columns on its survivors."""
    if cfg.mode not in ("verified", "sequential"):
        raise ValueError("mode must be 'verified' or 'sequential'")
    if cfg.mode == "sequential":
        near = near_dedup(df, NearConfig(text_cols=cfg.columns[:1], threshold=cfg.near_threshold, keep=cfg.keep,
                                         id_col=cfg.id_col))
        return fuzzy_dedup(near, FuzzyConfig(columns=cfg.columns, threshold=cfg.fuzzy_threshold, keep=cfg.keep,
                                             id_col=cfg.id_col))
    if cfg.keep == "none" or cfg.scorer == "ratio":
        reps, verified = combined_pairs(df, cfg)
        return _survivors(df, reps, verified, cfg.keep, cfg.id_col)
    reps = _combined_reps(df, cfg)
    t = cfg.near_threshold

    def build(live):
        prefix, candidates = _prefix_join(jaccard_sets(live), t)
        return prefix, ["w"], candidates, (lambda c: _combined_verify(c, live, cfg))
    return _seeded(df, reps, cfg.keep, cfg.id_col, build)


def pair_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision / recall / F1 of a pair set (id_a < id_b) against a truth pair set."""
    f = found.select("id_a", "id_b").distinct()
    t = truth.select("id_a", "id_b").distinct()
    stats = (f.withColumn("__f", F.lit(1)).join(t.withColumn("__t", F.lit(1)), ["id_a", "id_b"], "full")
             .agg(F.count_if(F.col("__f").isNotNull() & F.col("__t").isNotNull()).alias("tp"),
                  F.count_if(F.col("__f").isNotNull()).alias("n_found"),
                  F.count_if(F.col("__t").isNotNull()).alias("n_truth")))
    p = F.col("tp") / F.nullif(F.col("n_found"), F.lit(0))
    r = F.col("tp") / F.nullif(F.col("n_truth"), F.lit(0))
    return stats.select("tp", "n_found", "n_truth", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
                        F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 6).alias("f1"))


def dedup_counts(before: DataFrame, after: DataFrame, method: str, id_col: str = "paper_id") -> DataFrame:
    """D8 for any method: original / remaining / removed and percent, one pass over the input."""
    flagged = before.select(id_col).join(after.select(id_col).withColumn("__kept", F.lit(True)), id_col, "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("original_count"),
        F.count_if(F.col("__kept").isNotNull()).alias("remaining_count"),
        F.count_if(F.col("__kept").isNull()).alias("removed_count"),
    ).select(F.lit(2).alias("stage"), F.lit("Duplicate removal").alias("action"), F.lit(method).alias("method"),
             "original_count", "remaining_count", "removed_count",
             percent("removed_count", "original_count").alias("removed_pct"))
