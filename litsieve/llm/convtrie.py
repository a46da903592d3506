"""Prefix trie of conversations, its subtree sums by the Euler-tour technique.

A node is a distinct sequence of first turns. It is named by its depth and the sum of 96-bit digests of
(place, turn) over its turns, so names come from prefix sums, however long a conversation is. The tour goes
down and up every node by an enter and an exit arc, children in the order of their smallest conversation.
Each arc knows its successor; the list is ranked in two steps: nodes lie in blocks by (conversation, depth),
and every block contracts the chains inside it; pointer jumping ranks the chains that are left (doubling
rounds, each an equi-join whose keys occur once). Prefix sums at the arc positions then give the subtree sums:
what lies between a node's enter and exit arc is its subtree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.llm.common import columns, cut_lineage, positions, salted_left_join, shuffle_width

BLOCK_NODES = 1 << 12       # nodes whose arcs one task contracts at a time, and arcs in a block of the prefix sums / 2
ENDS_PER_PIECE = 512        # conversation ids joined into one piece of a node's list
NAME = "decimal(38,0)"      # holds the sum of 10^9 digests of 96 bits


def turn_digest() -> Column:
    """Digest of a turn's role and text, told apart by the role's length."""
    return F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)


def _digest_number() -> Column:
    """96 bits of the digest of (depth, turn) as a decimal."""
    digest = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest").cast("binary"), 256)
    high, low = (F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(15,0)") for at in (1, 13))
    return (high * F.lit(1 << 48).cast("decimal(15,0)") + low).cast(NAME)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest, bytes: turns in order (null first, ties by digest); rows without a
    conv_id belong to no conversation."""
    rows = columns(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", turn_digest().alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    return positions(rows, ["conv_id"], ["turn", "digest"], rank="place").select("conv_id", "place", "digest", "bytes")


def rebuild(turns: DataFrame, family: int = 5, shared: int = 9) -> tuple[DataFrame, DataFrame]:
    """(rebuilt turns: conv_id, depth from 1, digest, bytes; conversations: conv_id, n_turns).

    The first h = crc32(conv_id) % ``shared`` turns come from the conversation that leads the ``family`` ids.
    """
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(shared)).cast("long")
    own = cut_lineage(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    leads = own.select(F.col("conv_id").alias("leader"), F.col("n").alias("n_leader"))
    convs = own.withColumns({"head": head, "leader": F.col("conv_id") - F.col("conv_id") % F.lit(family)}).join(leads, "leader", "left")
    convs = cut_lineage(convs.withColumn("given", F.least("head", F.coalesce("n_leader", F.lit(0)))))
    given = convs.select(F.col("conv_id").alias("member"), "leader", "given").where("given > 0")
    first = turns.where(F.col("place") < shared - 1).withColumnRenamed("conv_id", "leader")
    first = first.join(given, "leader").where("place < given").select(F.col("member").alias("conv_id"), (F.col("place") + 1).alias("depth"), "digest", "bytes")
    rest = salted_left_join(turns.where(F.col("place") >= head), convs.select("conv_id", "head", "given"), "conv_id", F.col("place"))
    rest = rest.select("conv_id", (F.col("place") - F.col("head") + F.col("given") + 1).alias("depth"), "digest", "bytes")
    return first.unionByName(rest), convs.select("conv_id", (F.col("given") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("n_turns"))


def _name(depth: str, number: str) -> Column:
    return F.concat_ws("/", F.col(depth).cast("string"), F.col(number).cast("string"))


def trie_nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: name, parent, depth, conv_id, n_convs, bytes; ends: name, conv_id of the last node of each conversation)."""
    numbered = turns.select("conv_id", "depth", "bytes", _digest_number().alias("number"))
    summed = positions(numbered, ["conv_id"], ["depth"], weight="number", weight_type=NAME)
    summed = cut_lineage(summed.select("conv_id", "depth", "bytes", F.col("before").alias("above"), (F.col("before") + F.col("number")).cast(NAME).alias("number")))
    nodes = summed.groupBy("depth", "number").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                                  F.max("bytes").alias("bytes"), F.max("above").alias("above"))
    nodes = nodes.select(_name("depth", "number").alias("name"), F.concat_ws("/", (F.col("depth") - 1).cast("string"), F.col("above").cast("string")).alias("parent"),
                         "depth", "conv_id", "n_convs", "bytes")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit("0/0").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"))
    lasts = convs.select(F.col("conv_id"), F.col("n_turns").alias("depth"))
    ends = summed.select("conv_id", "depth", "number").join(lasts, ["conv_id", "depth"]).select(_name("depth", "number").alias("name"), "conv_id")
    return nodes.unionByName(root), ends.unionByName(convs.where("n_turns = 0").select(F.lit("0/0").alias("name"), "conv_id"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """name, ends_sha256: ids are joined in pieces of ENDS_PER_PIECE by all tasks; one task then runs the digest
    over a node's pieces in order, holding only the digest's state."""
    placed = positions(ends, ["name"], ["conv_id"], rank="place")
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    pieces = placed.groupBy("name", F.floor(F.col("place") / ENDS_PER_PIECE).alias("piece")).agg(F.array_join(ids, ",").alias("ids"))
    ordered = pieces.repartition(shuffle_width(ends), "name").sortWithinPartitions("name", "piece")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None

        def done(names, states):
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(states, pa.string())], ["name", "ends_sha256"])

        for batch in batches:
            names, states = [], []
            for n, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
                if n == name:
                    state.update(b"," + ids.encode())
                    continue
                if name is not None:
                    names.append(name)
                    states.append(state.hexdigest())
                name, state = n, sha256(ids.encode())
            yield done(names, states)
        if name is not None:
            yield done([name], [state.hexdigest()])

    return ordered.mapInArrow(digest, "name string, ends_sha256 string")


# ------------------------------------------------------------------- Euler tour

def euler_tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with no, parent_conv_id, n_children; arcs: arc, next (null after the last)). Arc 2 no enters, 2 no + 1 exits.

    ``nodes``: name (unique), parent, conv_id, depth; children of a node follow one another by conv_id.
    """
    placed = positions(nodes.select("name", "parent", "conv_id", "depth"), [], ["conv_id", "depth"], rank="no").drop("before")
    placed = cut_lineage(placed)
    below = placed.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(
        F.count(F.lit(1)).alias("n_children"), F.min(F.struct("conv_id", "no"))["no"].alias("first_child"))
    own = cut_lineage(placed.join(below, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    above = own.select(F.col("name").alias("parent"), F.col("no").alias("parent_no"), F.col("conv_id").alias("parent_conv_id"))
    known = salted_left_join(own, above, "parent", F.col("no"))
    siblings = positions(known.select("no", "parent_no", "conv_id").where("parent_no is not null"), ["parent_no"], ["conv_id"], rank="place")
    siblings = cut_lineage(siblings.select("parent_no", "place", "no"))
    after = siblings.select("parent_no", (F.col("place") - 1).alias("place"), F.col("no").alias("next_no"))
    next_of = siblings.join(after, ["parent_no", "place"], "left").select("no", "next_no")
    known = cut_lineage(known.join(next_of, "no", "left").select("name", "no", "n_children", "first_child", "next_no", "parent_no", "parent_conv_id"))
    enter = F.coalesce(F.col("first_child") * 2, F.col("no") * 2 + 1)
    leave = F.coalesce(F.col("next_no") * 2, F.col("parent_no") * 2 + 1)
    arcs = known.select("n_children", F.explode(F.array(F.struct((F.col("no") * 2).alias("arc"), enter.alias("next")),
                                                        F.struct((F.col("no") * 2 + 1).alias("arc"), leave.alias("next")))).alias("a"))
    return known.select("name", "no", "n_children", "parent_conv_id"), arcs.select("a.arc", "a.next")


def contract_blocks(arcs: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """arc, tail, hops, out: the last arc of the chain that an arc is on inside its block, the steps to it, and
    (on a tail) the arc of another block that follows."""
    def contract(table: pa.Table) -> pa.Table:
        arc = table.column("arc").to_numpy()
        after = table.column("next").to_pandas().fillna(-1).to_numpy().astype(np.int64)
        order = np.argsort(arc)
        sorted_arcs = arc[order]
        found = np.minimum(np.searchsorted(sorted_arcs, after), len(arc) - 1)
        inside = sorted_arcs[found] == after
        jump = np.where(inside, order[found], np.arange(len(arc)))
        hops = inside.astype(np.int64)
        while True:                                     # a chain's end jumps to itself by no step
            further = jump[jump]
            if (further == jump).all():
                break
            hops, jump = hops + hops[jump], further
        out = np.where(~inside & (after >= 0), after, -1)
        return pa.Table.from_arrays([pa.array(arc), pa.array(arc[jump]), pa.array(hops), pa.array(out, mask=out < 0)], ["arc", "tail", "hops", "out"])

    blocked = arcs.withColumn("block", F.floor(F.col("arc") / (2 * block_nodes)))
    return blocked.groupBy("block").applyInArrow(contract, "arc long, tail long, hops long, out long")


def list_ranks(arcs: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """arc, position: the place of each arc on the list, from 0."""
    chained = cut_lineage(contract_blocks(arcs, block_nodes))
    tails = chained.where("arc = tail")
    onto = chained.select(F.col("arc").alias("out"), F.col("tail").alias("to"), (F.col("hops") + 1).alias("steps"))
    left = cut_lineage(tails.select("tail", "out").join(onto, "out", "left").select("tail", "to", F.coalesce("steps", F.lit(0)).alias("steps")))
    for _ in range(math.ceil(math.log2(max(1, left.count())))):
        ahead = left.select(F.col("tail").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        moved = left.where("to is not null").join(ahead, "to").select("tail", F.col("to2").alias("to"), (F.col("steps") + F.col("steps2")).alias("steps"))
        left = cut_lineage(moved.unionByName(left.where("to is null")))
    total = chained.count()
    ranked = chained.join(left.select("tail", "steps"), "tail")
    return ranked.select("arc", (F.lit(total - 1) - F.col("hops") - F.col("steps")).alias("position"))


def prefix_sums(rows: DataFrame, at: str, values: list[str], block: int = 2 * BLOCK_NODES) -> DataFrame:
    """Replaces each value by the sum over rows up to this one; ``at`` numbers the rows from 0 without gaps."""
    rows = rows.withColumn("_block", F.floor(F.col(at) / block))
    sums = rows.groupBy("_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)     # one row for each block
    offsets = sums.select("_block", *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy("_block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(offsets, "_block").withColumns({v: F.col(f"_{v}") + F.sum(v).over(inside) for v in values}).drop("_block", *[f"_{v}" for v in values])


def subtree_sums(nodes: DataFrame, arcs: DataFrame, values: list[str], block_nodes: int = BLOCK_NODES) -> DataFrame:
    """no and, for each of the nodes' value columns, its sum over the node's subtree, the node included."""
    entered = nodes.select((F.col("no") * 2).alias("arc"), *values)
    ranked = cut_lineage(list_ranks(arcs, block_nodes).join(entered, "arc", "left").select("arc", "position", *[F.coalesce(v, F.lit(0)).alias(v) for v in values]))
    at_enter = (F.col("arc") % 2 == 0)
    kept = ranked.select("arc", "position", *values, *[F.col(v).alias(f"own_{v}") for v in values])
    summed = prefix_sums(kept, "position", values, 2 * block_nodes)
    before = [F.sum(F.when(at_enter, F.col(f"own_{v}") - F.col(v)).otherwise(F.col(v))).alias(v) for v in values]
    return summed.groupBy(F.floor(F.col("arc") / 2).alias("no")).agg(*before)


def conversation_trie(conversations: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> one row per node of the trie of rebuilt conversations: conv_id
    (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by turn, nulls first, ties by a digest of role and text; repeated rows are turns of their own; null
    roles and texts are empty. Rows without conv_id belong to no conversation and take no part. A conversation
    left without turns is a member of the root only. An empty table gives no rows, not even a root. Other columns
    are left behind.
    """
    turns, convs = rebuild(cut_lineage(ordered_turns(conversations)))
    convs = cut_lineage(convs)
    nodes, ends = trie_nodes(turns, convs)
    nodes = cut_lineage(nodes)
    tour, arcs = euler_tour(nodes)
    known = cut_lineage(nodes.join(tour, "name").withColumns({
        "n_leaves": F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}))
    sums = subtree_sums(known, arcs, ["n_leaves", "saved_tokens"], block_nodes)
    out = known.drop("n_leaves", "saved_tokens").join(sums, "no").join(ends_digests(ends), "name", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))
