"""Similarity joins by cells: rows of like sizes in blocks, and a task for each pair of blocks that can hold a pair.

A join on signatures shuffles a row for each signature that two rows share, and sorts them again to count by pair:
on texts of few letters that is a row for nearly every pair of like lengths. Here the rows themselves are sent to
the cells (a size band's blocks against those of the same and the next band) and pairs are counted inside one, in
arrays of bounded size. What is shuffled is each row once per block of its own and the neighbouring bands; blocks
hold ``CELL_WEIGHT`` at most on average, so that neither memory nor a task grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_WEIGHT = 16_000_000
ROW_WEIGHT = 500           # of a row besides its payload: bounds the rows of a block
MEETINGS = 4_000_000       # shared signatures in memory at a time
COUNTERS = 16_000_000      # pairs counted at a time

CELL = ["__r", "__rb", "__sb"]


def cells(rows: DataFrame, band: str, weight: str, width: int | None = None) -> DataFrame:
    """``rows`` once per cell (__r, __rb, __sb): a band's block of the smaller sizes, and the number of the blocks, in that
    band and the next, that hold its partners. A row is on side r where (band, __block) is (__r, __rb), on side s where
    __block is __sb."""
    sizes = rows.groupBy(F.col(band).alias("__at")).agg(F.ceil(F.sum(F.col(weight) + ROW_WEIGHT) / F.lit(CELL_WEIGHT)).cast("int").alias("__n"))
    found = {at: n for at, n in sizes.collect()}       # a row per band: as many as the logarithm of the largest size
    if not found:
        return rows.withColumns({c: F.lit(0).cast("long") for c in [*CELL, "__block"]})
    blocks = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])

    def each(count, cell):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), cell)).otherwise(F.array().cast("array<struct<__r:bigint,__rb:int,__sb:int>>"))

    def cell(r, rb, sb):
        return F.struct(r.cast("long").alias("__r"), rb.cast("int").alias("__rb"), sb.cast("int").alias("__sb"))

    own, block = F.col(band), F.col("__block")
    spread = (rows.withColumns({"__n": F.try_element_at(blocks, own), "__before": F.try_element_at(blocks, own - 1),
                                "__most": F.greatest(F.try_element_at(blocks, own), F.try_element_at(blocks, own + 1))})
              .withColumn("__block", F.pmod(F.xxhash64("id"), F.col("__n")).cast("int"))
              .withColumn("__cell", F.explode(F.array_distinct(F.concat(
                  each("__most", lambda x: cell(own, block, x)),
                  each("__n", lambda x: cell(own, x, block)),
                  each("__before", lambda x: cell(own - 1, x, block))))))
              .select(*rows.columns, "__block", "__cell.*"))
    count = sum(n * max(n, found.get(at + 1, 0)) for at, n in found.items())
    width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(count, 4 * sum(found.values())))
    return spread.repartition(width, *CELL)


def sides(table: pa.Table, band: str) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (r, s) of a cell's sides."""
    r, rb, sb = (table.column(c)[0].as_py() for c in CELL)
    at, block = table.column(band).to_numpy(), table.column("__block").to_numpy()
    return np.flatnonzero((at == r) & (block == rb)), np.flatnonzero(block == sb)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Index:
    """Signatures (uint64) of one side, sorted, with what they stand for."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        ordered = keys[self.order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, dtype=np.int64)
        self.keys, self.starts = ordered[starts], starts
        self.counts = np.diff(np.r_[starts, len(ordered)])
        self.bits = np.uint64(64 - max(10, int(4 * len(self.keys)).bit_length()))
        self.there = np.zeros(1 << int(64 - self.bits), dtype=bool)
        self.there[self.keys >> self.bits] = True

    def meet(self, probes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number in the index, number in probes) of equal signatures, some MEETINGS at a time."""
        if not len(self.keys) or not len(probes):
            return
        some = np.flatnonzero(self.there[probes >> self.bits])
        at = np.searchsorted(self.keys, probes[some])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == probes[some]
        some, at = some[hit], at[hit]
        starts, counts = self.starts[at], self.counts[at]
        ends = np.cumsum(counts)
        i = 0
        while i < len(some):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + MEETINGS, side="right")))
            n = counts[i:j]
            before = np.cumsum(n) - n
            place = np.arange(int(n.sum())) + np.repeat(starts[i:j] - before, n)
            yield self.order[place], np.repeat(some[i:j], n)
            i = j


def pairs_by_cell(rows: DataFrame, band: str, weight: str, find: Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(id_a < id_b), each pair of ids once, even where ids repeat: what ``find(table, r, s)`` gives as row numbers for every cell."""
    def inside(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        out = [np.zeros((2, 0), dtype=np.int64)]
        for a, b in find(table, *sides(table, band)):
            out.append(np.stack((np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]))))
        a, b = np.concatenate(out, axis=1)
        return pa.table({"id_a": pa.array(a, pa.int64()), "id_b": pa.array(b, pa.int64())})

    return cells(rows, band, weight).groupBy(*CELL).applyInArrow(inside, "id_a long, id_b long").distinct()
