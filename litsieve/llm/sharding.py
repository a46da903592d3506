"""Minimax contiguous partition of atomic groups into shards of near-equal bytes.

Documents with equal texts stay together. Texts are dealt to CELLS cells by a hash, a cell being the
ordered atomic group, so the table of group sizes is bounded whatever the input (at most CELLS sums reach
the driver). The smallest feasible capacity is found by binary search, each candidate checked greedily,
and the order is cut there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.llm.common import columns, cut_lineage, positions

CELLS = 1 << 16
OVERHEAD = 8


def _greedy(ends: np.ndarray, shards: int, capacity: int) -> list[int] | None:
    """Group counts at which a greedy fill ends each shard; None if ``shards`` do not suffice."""
    cuts, start, base = [], 0, 0
    for _ in range(shards):
        start = int(np.searchsorted(ends, base + capacity, side="right"))
        cuts.append(start)
        if start == len(ends):
            return cuts + [start] * (shards - len(cuts))
        base = int(ends[start - 1]) if start else 0
    return None


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """(smallest capacity, end of each shard as a group count) of a contiguous partition."""
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes):
        return 0, [0] * shards
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if _greedy(ends, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low, _lifted(ends, shards, low, _greedy(ends, shards, low))


def _lifted(ends: np.ndarray, shards: int, capacity: int, latest: list[int]) -> list[int]:
    """Cuts under the same capacity whose smallest shard is as large as it can be.

    A greedy fill leaves the last shards short. Cut ``i`` may stand anywhere from its earliest place (the rest still
    fits) to the greedy one; the largest floor for which a fill of at least that much reaches the end is found by
    binary search, a fill taking the first cut that reaches the floor."""
    earliest, base = [len(ends)] * shards, int(ends[-1])
    for i in range(shards - 2, -1, -1):
        earliest[i] = int(np.searchsorted(ends, base - capacity, side="left")) + (base > capacity)
        base = int(ends[earliest[i] - 1]) if earliest[i] else 0

    def filled(floor: int) -> list[int] | None:
        cuts, base = [], 0
        for i in range(shards):
            cut = max(int(np.searchsorted(ends, base + floor, side="left")) + (floor > 0), earliest[i], cuts[-1] if cuts else 0)
            if i == shards - 1:
                cut = len(ends)
            if cut > latest[i] or (cut and int(ends[cut - 1]) - base > capacity) or (int(ends[cut - 1]) if cut else 0) - base < floor:
                return None
            cuts.append(cut)
            base = int(ends[cut - 1]) if cut else 0
        return cuts

    low, high, best = 0, int(ends[-1]) // shards, latest
    while low <= high:
        middle = (low + high) // 2
        cuts = filled(middle)
        if cuts is None:
            high = middle - 1
        else:
            low, best = middle + 1, cuts
    return best


def shard_documents(docs: DataFrame, shards: int = 24, cells: int = CELLS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per input row.

    size is the UTF-8 bytes of the text plus 8 (null: 8; its checksum is that of no bytes, 0, and it lies
    with the empty texts); equal texts share a shard; slots run from 0 in each shard by cell, checksum
    and doc_id; repeated rows get a slot each; null doc_ids come first; an empty table gives no rows.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = cut_lineage(columns(docs, doc_id="long", text="string").select(
        "doc_id", (F.octet_length(data) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.pmod(F.xxhash64(data), F.lit(cells)).cast("int").alias("cell")))
    sums = rows.groupBy("cell").agg(F.sum("size").alias("size")).orderBy("cell").collect()
    _, ends = minimax_cuts([r["size"] for r in sums], shards)
    order = [r["cell"] for r in sums]
    first = [order[e] if e < len(order) else cells for e in ends[:-1]]   # the cell that opens the next shard
    placed = rows.withColumn("shard", F.size(F.filter(F.array(*[F.lit(c) for c in first] or [F.lit(cells)]), lambda c: c <= F.col("cell"))))
    out = positions(placed, ["shard"], ["cell", "text_crc32", "doc_id"], rank="slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
