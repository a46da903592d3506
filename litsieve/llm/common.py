"""Helpers shared by the training-data operators: column selection, stable positions, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.session import cut_lineage, read_table

__all__ = ["columns", "cut_lineage", "read_table", "positions", "tie_break", "components", "salted_left_join", "shuffle_width"]


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Exactly the named columns, cast; every other column of the input is left behind, so none can clash."""
    return df.select(*[df[name].cast(kind).alias(name) for name, kind in types.items()])


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tie_break(df: DataFrame) -> Column:
    """Order among rows equal in doc_id and text: by the other columns, so that a rerun takes the same row."""
    others = [F.col(c) for c in df.columns if c not in ("doc_id", "text")]
    return F.to_json(F.struct(*others)) if others else F.lit(1)


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str | None = None,
              rank: str = "rank", before: str = "before", weight_type: str = "long") -> DataFrame:
    """Adds the 0-based rank of each row in its group, and the sum of ``weight`` (a long unless said) in front of it.

    A window over the group would put a hot group into one task. Here rows are range-partitioned by
    (group, order), the assignment is fixed by a checkpoint, each partition's totals per group (at most
    groups + partitions rows) become offsets, and the window runs inside (partition, group).
    ``df`` should be cheap to read twice, as range partitioning samples it.
    """
    keys = [*group, *order]
    placed = cut_lineage(df.repartitionByRange(shuffle_width(df), *keys).withColumn("_part", F.spark_partition_id()))
    w = (F.col(weight) if weight else F.lit(0)).cast(weight_type)
    totals = placed.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
                            F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"))
    right = offsets.select(F.col("_part").alias("_p2"), *[F.col(g).alias(f"_{g}2") for g in group], "_n0", "_w0")
    on = (F.col("_part") == F.col("_p2"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}2"))
    inside = Window.partitionBy("_part", *group).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(right, on).withColumns({
        rank: F.col("_n0") + F.row_number().over(inside) - 1,
        before: (F.col("_w0") + F.sum(w).over(so_far) - w).cast(weight_type),
    })
    return out.drop("_part", "_p2", "_n0", "_w0", *[f"_{g}2" for g in group])


def salted_left_join(left: DataFrame, right: DataFrame, key: str, salt_from: Column, salts: int = 8) -> DataFrame:
    """Left join on ``key`` where ``left`` may hold one key in a third of its rows: each key is spread
    over ``salts`` tasks, the (unique-key) right side is repeated as often."""
    spread = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    return salted.join(spread, [key, "_salt"], "left").drop("_salt")


def components(edges: DataFrame, checkpoint_every: int = 1) -> DataFrame:
    """Connected components of edges(a, b): returns (node, root), root the smallest node reachable.

    Alternating large-star / small-star rounds (O(log^2 n) of them), each an aggregate and a join on
    the node; a component's star centre is a hot key only of the join's splittable side. Round state
    is cut with a reliable checkpoint; nothing is collected but one row (count and hash sum) a round.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    e = cut_lineage(edges.where("a <> b").select(hi.alias("u"), lo.alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
