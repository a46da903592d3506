"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source gets a target of words. Its documents stand in a permuted order; whole passes over them, then
a part of one more, fill the target. One pass of one document is a draw, a run of draws in permuted order a
block. The tree splits the exact block quotas of all sources between the two halves of the output shards,
again and again, each time by one multivariate-hypergeometric draw; a shard then takes the next blocks of
each source's order, so blocks are disjoint, and shuffles its draws locally.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsieve.llm.common import columns, cut_lineage, positions, tie_break

WEIGHTS = (5, 2, 1)
MOST = 3               # a source's target is at most so many times its size
SHARD_DRAWS = 8_192     # draws of one output shard, of which there are LEAST_SHARDS at least
LEAST_SHARDS = 16
SEED = 20240607
MAX_BLOCKS = 100_000_000   # numpy's hypergeometric takes below 10^9; more draws make larger blocks
#: Single documents that fill up the last pass when no further one fits: of any, and one that may pass the target.
TOP_UPS = ("any", "any", "nearest")
WORDS = r"[^ \t-\r]+"


def targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size, ...) -> with target: shares by weight, capped, the excess reshared.

    Water-filling: target = min(MOST * size, level * weight); a round sums what is capped and raises the
    level, until no further source is. Only three sums a round come to the driver.
    """
    ranked = positions(sizes.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"], rank="_rank")
    weighted = cut_lineage(ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))))
    cap, level = F.col("source_size") * float(MOST), 0.0
    total = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped = -1
    while total:
        full = F.col("_weight") * F.lit(level) > cap
        n, kept, free = weighted.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
                                     F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - kept) / free
    return weighted.withColumn("target", F.least(cap, F.col("_weight") * F.lit(level))).drop("_weight", "_last", "before")


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(sources, shards) block counts: rows sum to the quotas, columns are equal within one block."""
    if shards == 1:
        return quotas[:, None]
    left, blocks = shards // 2, int(quotas.sum())
    first = rng.multivariate_hypergeometric(quotas, blocks * left // shards, method="marginals") if blocks else np.zeros_like(quotas)
    return np.concatenate((split_quotas(first, left, rng), split_quotas(quotas - first, shards - left, rng)), axis=1)


def _tree(frames: Iterator[pd.DataFrame], shards: int, seed: int) -> Iterator[pd.DataFrame]:
    """One row a source (never one a document) -> the place in its order at which each shard's blocks end."""
    held = [f for f in frames if len(f)]
    if held:
        rows = pd.concat(held, ignore_index=True)
        rows = rows.sort_values("_rank", kind="stable", ignore_index=True)
        draws = rows["draws"].to_numpy(np.int64)
        block = max(1, -(-int(draws.sum()) // MAX_BLOCKS))
        parts = split_quotas(-(-draws // block), shards, np.random.default_rng(seed))
        ends = np.minimum(np.cumsum(parts, axis=1) * block, draws[:, None])
        yield pd.DataFrame({"_rank": rows["_rank"], "ends": list(ends)})


def mixture(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, source) -> one row per input row: doc_id, key (hash of the text), size, source,
    source_size, target, copies, and shards: the output shard of each of its draws.

    Sizes are words of the whole text (null or empty: 0, never drawn beyond whole passes). Sources go by
    code point, null last. Whole passes first; the last, partial pass takes the longest prefix of the
    permuted order that fits, again and again the longest prefix of those left that are not longer than the gap,
    until none is, then the single documents of TOP_UPS, each the largest that still fits, none
    more than MOST times in all, and one that may pass the target if the source then ends nearer to it.
    Repeated rows are separate documents; ties in the order go by doc_id; the same input and seed give the
    same mix; an empty table gives no rows.
    """
    base = columns(docs, doc_id="long", source="string", text="string").select(
        "doc_id", "source", F.xxhash64("text").alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    base = cut_lineage(base.withColumn("_turn", F.xxhash64(F.lit(seed), "doc_id", "key")))
    sources = targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = cut_lineage(sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))

    def with_source(rows, table, *names):
        table = table.select(F.col("source").alias("_s"), *names)
        return rows.join(table, rows["source"].eqNullSafe(table["_s"])).drop("_s")

    placed = positions(base, ["source"], ["_turn", "doc_id"], weight="size", rank="at")
    placed = with_source(placed, sources, "passes", "rest")
    fits = (F.col("before") + F.col("size") <= F.col("rest")) & (F.col("size") > 0)
    placed = cut_lineage(placed.withColumn("_prefix", fits))
    state = sources.withColumns({"gap": F.col("rest"), "next": F.lit(0).cast("long"), "extras": F.array().cast("array<long>")})

    def after(state, drawn):
        """``drawn``: rows(source, _pick, size) of one prefix."""
        sums = drawn.groupBy(F.col("source").alias("_s")).agg(F.sum("size").alias("_got"), F.max("_pick").alias("_end"))
        return cut_lineage(state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").withColumns({
            "gap": F.col("gap") - F.coalesce("_got", F.lit(0)), "next": F.coalesce(F.col("_end") + 1, F.col("next"))}).drop("_s", "_got", "_end"))

    state = after(state, placed.where("_prefix").select("source", F.col("at").alias("_pick"), "size"))
    left, picked = placed.where("size > 0 and not _prefix").select("source", "at", "size"), []
    while True:  # each round's gap is smaller than a document that the round before had room for
        left = cut_lineage(with_source(left, state, "gap", "next").where("size <= gap"))
        if left.isEmpty():
            break
        ranked = cut_lineage(positions(left, ["source"], ["at"], weight="size", rank="_rank", before="_before"))
        takes = F.col("_before") + F.col("size") <= F.col("gap")
        drawn = ranked.where(takes).select("source", "at", (F.col("next") + F.col("_rank")).alias("_pick"), "size")
        state, left = after(state, drawn), ranked.where(~takes).select("source", "at", "size")
        picked.append(drawn.select(F.col("source").alias("_s"), F.col("at").alias("_a"), "_pick"))
    if picked:
        more = reduce(DataFrame.unionByName, picked)
        placed = placed.join(more, F.col("source").eqNullSafe(F.col("_s")) & (F.col("at") == F.col("_a")), "left").drop("_s", "_a")
    else:
        placed = placed.withColumn("_pick", F.lit(None).cast("long"))
    placed = cut_lineage(placed.withColumn("_pick", F.when(F.col("_prefix"), F.col("at")).otherwise(F.col("_pick"))).drop("_prefix"))
    for kind in TOP_UPS:  # one document a source and round
        state = cut_lineage(state)
        left = with_source(placed.where("size > 0"), state, "gap", "extras")
        often = F.size(F.filter("extras", lambda x: x == F.col("at")))
        may = F.col("passes") + F.col("_pick").isNotNull().cast("int") + often < MOST
        left = left.where((F.col("size") < F.col("gap") * (2 if kind == "nearest" else 1)) & may)
        best = left.groupBy(F.col("source").alias("_s")).agg(F.max(F.struct(F.negative(F.abs(F.col("size") - F.col("gap"))), F.negative("at").alias("no"), "size")).alias("_b"))
        state = state.join(best, F.col("source").eqNullSafe(F.col("_s")), "left").withColumns({
            "gap": F.col("gap") - F.coalesce("_b.size", F.lit(0)),
            "extras": F.when(F.col("_b").isNull(), F.col("extras")).otherwise(F.concat("extras", F.array(F.negative("_b.no"))))}).drop("_s", "_b")
    state = cut_lineage(state.withColumn("draws", F.col("passes") * F.col("n_docs") + F.col("next") + F.size("extras")))
    shards = shards or max(LEAST_SHARDS, -(-(state.agg(F.sum("draws")).first()[0] or 0) // SHARD_DRAWS))
    ends = (state.select("_rank", "draws").coalesce(1)
            .mapInPandas(lambda it: _tree(it, shards, seed), "_rank long, ends array<long>"))
    state = state.join(ends, "_rank")
    out = with_source(placed.drop("passes", "rest"), state, "source_size", "target", "passes", "n_docs", "next", "extras", "ends")
    whole = F.when(F.col("passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).otherwise(F.array().cast("array<long>"))
    spare = F.filter(F.transform("extras", lambda x, i: F.when(x == F.col("at"), F.col("next") + i)), lambda i: i.isNotNull())
    last = F.concat(F.when(F.col("_pick").isNotNull(), F.array("_pick")).otherwise(F.array().cast("array<long>")), spare)
    draws = F.concat(F.transform(whole, lambda p: p * F.col("n_docs") + F.col("at")),
                     F.transform(last, lambda i: F.col("passes") * F.col("n_docs") + i))
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(int(shards).bit_length()))])

    def shard_of(draw):
        """How many shards end at or before the draw, by binary search (a place beyond the ends is null, so not taken)."""
        return F.aggregate(halves, F.lit(0), lambda low, step: F.when(F.get("ends", low + step - 1) <= draw, low + step).otherwise(low))

    out = out.withColumn("shards", F.transform(draws, shard_of))
    return out.select("doc_id", "key", "size", "source", "source_size", "target", F.size("shards").alias("copies"), "shards")


def mix(docs: DataFrame, shards: int | None = None, seed: int = SEED, shard_col: str = "shard") -> DataFrame:
    """The mixture itself: docs' rows, each as often as it is drawn, with its shard, shuffled within the shard.

    Rows equal in doc_id and text share their draws. A column of docs named ``shard_col`` gives way."""
    docs = docs.drop(shard_col)
    keys = {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_null": F.col("doc_id").isNull()}
    plan = mixture(docs, shards, seed).withColumnRenamed("key", "_key").withColumns(keys)
    plan = plan.groupBy("_id", "_null", "_key").agg(F.flatten(F.collect_list("shards")).alias("_shards")).where(F.size("_shards") > 0)
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), tie_break(docs).alias("_tie"), *[c.alias(n) for n, c in keys.items()],
                       F.xxhash64(F.col("text").cast("string")).alias("_key"))
    joined = rows.join(plan, ["_id", "_null", "_key"])
    joined = joined.withColumn("_row", F.row_number().over(Window.partitionBy("_id", "_null", "_key").orderBy("_tie"))).where("_row = 1")
    drawn = joined.select("_doc", F.posexplode("_shards").alias("_draw", "_shard"), "_id", "_key")
    return (drawn.withColumn("_turn", F.xxhash64(F.lit(seed + 1), "_id", "_key", "_draw"))
            .repartition("_shard").sortWithinPartitions("_shard", "_turn").select("_doc.*", F.col("_shard").alias(shard_col)))
