"""Greedy survivors (D16, D18): the reference's sequential scan, run as parallel rounds.

Sequential rule: scan rows in order; a row that is still present is kept and removes every
later row it matches; removed rows remove nothing. This is not connected components: with
edges 1-2 and 2-3, rows 1 and 3 survive.

Parallel form: orient every edge from the earlier to the later row. Per round, an undecided
row with an in-edge from a kept row is removed; an undecided row whose remaining in-edges all
come from removed rows is kept. Each round is a join and an aggregate over the (shrinking)
undecided edges; state is persisted per round and cut with a reliable checkpoint every few
rounds. The fixpoint equals the sequential scan.
"""

from __future__ import annotations

from itertools import count

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.session import cut_lineage

UNDECIDED, KEPT, REMOVED = 0, 1, 2


def orient(edges: DataFrame, keep: str = "first") -> DataFrame:
    """(a, b) undirected -> (src, dst) with src scanned first (smaller id for 'first')."""
    if keep == "first":
        return edges.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    if keep == "last":
        return edges.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct()
    raise ValueError("orient needs keep='first' or 'last'")


def greedy_removed(edges: DataFrame, keep: str = "first", checkpoint_every: int = 4) -> DataFrame:
    """Ids removed by the greedy scan over an undirected edge list (a, b).

    keep='none' removes every row that has any neighbour. Per round: one join of the live
    edges with the source state, one aggregate by target, one join back into the state. Round
    state is persisted (memory and disk) and cut with a reliable checkpoint every
    ``checkpoint_every`` rounds, so lineage stays short and a lost executor costs at most that
    many rounds of recomputation.
    """
    if keep == "none":
        return edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    e = cut_lineage(orient(edges, keep))
    # round 0 is free: a row without an earlier neighbour is kept, every other row is undecided
    targets = e.select(F.col("dst").alias("id")).distinct().withColumn("__t", F.lit(True))
    nodes = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    state = cut_lineage(nodes.join(targets, "id", "left")
                        .select("id", F.when(F.col("__t"), F.lit(UNDECIDED)).otherwise(F.lit(KEPT)).alias("st")))
    held = []
    for rnd in count(1):  # every round decides the smallest undecided row, so the rounds end
        # edges whose source is kept remove their target; edges from undecided sources stay live;
        # edges from removed sources no longer matter
        live = e.join(state.select(F.col("id").alias("src"), F.col("st").alias("s_st")), "src") \
            .filter(F.col("s_st") != REMOVED)
        per_dst = live.groupBy("dst").agg(
            F.max((F.col("s_st") == KEPT).cast("int")).alias("hit_kept"),
            F.max((F.col("s_st") == UNDECIDED).cast("int")).alias("has_undecided"))
        nxt = (state.join(per_dst, state["id"] == per_dst["dst"], "left")
               .select("id", F.when(F.col("st") != UNDECIDED, F.col("st"))
                       .when(F.coalesce(F.col("hit_kept"), F.lit(0)) == 1, F.lit(REMOVED))
                       .when(F.coalesce(F.col("has_undecided"), F.lit(0)) == 1, F.lit(UNDECIDED))
                       .otherwise(F.lit(KEPT)).alias("st")))
        nxt_e = live.filter(F.col("s_st") == UNDECIDED).select("src", "dst")
        if rnd % checkpoint_every == 0:
            # drop edges into rows decided meanwhile, then cut the lineage
            nxt = cut_lineage(nxt)
            und = nxt.filter(F.col("st") == UNDECIDED).select(F.col("id").alias("dst"))
            e, state = cut_lineage(nxt_e.join(und, "dst", "left_semi")), nxt
            for h in held:
                h.unpersist()
            held = []
        else:
            e, state = nxt_e.persist(StorageLevel.MEMORY_AND_DISK), nxt.persist(StorageLevel.MEMORY_AND_DISK)
            held += [e, state]
        if state.filter(F.col("st") == UNDECIDED).isEmpty():
            break
    return state.filter(F.col("st") == REMOVED).select("id")


HOT_LIST = 1000


def seeded_removed(prefix: DataFrame, key_cols: list[str], candidates, verify, hot_list: int | None = None) -> DataFrame:
    """Greedy removals (scan by ascending id) without pairing rows that are certainly removed.

    When no prefix key is shared by more than ``hot_list`` rows, every posting list is small
    and the plain candidate join runs. Otherwise:

    * A row none of whose prefix keys is shared with an earlier row has no earlier similar row
      (similar rows always share a prefix key): it is certainly kept (K0). Per prefix key only
      its smallest id can be in K0, so this step is one aggregate and one join, no pairs.
    * Rows similar to an earlier K0 row are certainly removed (R0): pairs K0 x list members,
      at most one K0 row per prefix key, so linear in the posting lists.
    * Only the remaining rows are paired with each other and resolved by ``greedy_removed``;
      they have no similar K0 row, and R0 rows absorb nothing, so their subgraph decides them.

    A dense cluster of near copies whose first row is in K0 is thus resolved with one pair per
    member instead of all pairs inside the cluster.

    prefix: (id, key columns..., filter columns); candidates(pa, pb) -> (id_a < id_b) sharing a
    key; verify(cand) -> verified (id_a, id_b, ...).
    """
    hot_list = HOT_LIST if hot_list is None else hot_list
    lists = prefix.groupBy(*key_cols).agg(F.min("id").alias("__m"), F.count(F.lit(1)).alias("__n"))
    lists = lists.persist(StorageLevel.MEMORY_AND_DISK)
    longest = lists.agg(F.max("__n")).first()[0] or 0
    if longest <= hot_list:
        edges = verify(candidates(prefix, prefix)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        removed = greedy_removed(edges, "first")
        lists.unpersist()
        return removed
    has_earlier = prefix.join(lists.select(*key_cols, "__m"), key_cols).filter(F.col("__m") < F.col("id")) \
        .select("id").distinct()
    ids = prefix.select("id").distinct()
    k0 = ids.join(has_earlier, "id", "left_anti").persist(StorageLevel.MEMORY_AND_DISK)
    r0 = (verify(candidates(prefix.join(k0, "id", "left_semi"), prefix))
          .select(F.col("id_b").alias("id")).distinct().persist(StorageLevel.MEMORY_AND_DISK))
    rest = prefix.join(k0, "id", "left_anti").join(r0, "id", "left_anti")
    edges = verify(candidates(rest, rest)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return r0.union(greedy_removed(edges, "first")).distinct()
