"""Association of numeric column pairs (E6-E9): grids, chi-square, phi_k and Kendall's tau-b.

All pairs are evaluated together: tasks count the bins of all pairs in one scan and shuffle only the
counts. NULL and NaN values take no part. Grids hold at most bins x bins cells a pair whatever the
table's size; Kendall keeps every distinct value, and sends a row once a column, not once a pair.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from litsieve.session import cut_lineage

GRID_BINS = 10
BLOCK_CELLS = 100_000
DENSE_CELLS = 1 << 24   # cells of count tables that a task fills in place
SORTED_ROWS = 1 << 18
COARSE_CELLS = 500_000
MOST_BLOCKS = 800       # of a column, as long as they stay under a million rows: tables of blocks then fit DENSE_CELLS


def number(c: str) -> Column:
    """The column as double, NaN as NULL."""
    v = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(v), v)


def ranges(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value per column; columns without values are left out."""
    r = df.agg(*[x for c in cols for x in (F.min(number(c)), F.max(number(c)))]).first()
    return {c: (r[2 * i], r[2 * i + 1]) for i, c in enumerate(cols) if r[2 * i] is not None}


def binned(c: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin 0..bins-1 of [lo, hi] (the maximum falls in the last bin); NULL stays NULL."""
    if hi == lo:
        return F.when(c.isNotNull(), F.lit(0))
    bin_ = F.least(F.floor((c - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo)), F.lit(bins - 1)).cast("int")
    return F.when(c.isNotNull(), bin_)  # least() skips NULLs


def _counted_pairs(batches: Iterator[pa.RecordBatch], code: Callable, sizes: list[int], pairs: list[tuple[int, int]]):
    """(p, x, y, n) of a task's rows: how many hold each pair of codes. ``code`` turns a batch into one array of codes
    a column (negative: no value), below ``sizes``. Tables of up to DENSE_CELLS cells in all are filled in place, each
    pair beyond that is counted by sorting, SORTED_ROWS at a time."""
    dense, room = {}, DENSE_CELLS
    for p in sorted(range(len(pairs)), key=lambda p: sizes[pairs[p][0]] * sizes[pairs[p][1]]):
        cells = sizes[pairs[p][0]] * sizes[pairs[p][1]]
        if cells <= room:
            dense[p], room = np.zeros(cells, np.int64), room - cells
    rest = {p: [] for p in range(len(pairs)) if p not in dense}

    def table(p, flat, n):
        x, y = np.divmod(flat, sizes[pairs[p][1]])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), p, np.int32)), pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64)),
                                           pa.array(n.astype(np.int64))], names=["p", "x", "y", "n"])
    held = 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            codes = code(batch)
            for p, (i, j) in enumerate(pairs):
                x, y = codes[i], codes[j]
                flat = (x * sizes[j] + y)[(x >= 0) & (y >= 0)]
                if p in dense:
                    np.add.at(dense[p], flat, 1) if len(dense[p]) > 4 * len(flat) else np.add(
                        dense[p], np.bincount(flat, minlength=len(dense[p])), out=dense[p])
                else:
                    rest[p].append(flat)
            held += batch.num_rows
        if batch is None or held >= SORTED_ROWS:
            for p, parts in rest.items():
                if parts:
                    yield table(p, *np.unique(np.concatenate(parts), return_counts=True))
                    rest[p] = []
            held = 0
    for p, counts in dense.items():
        at = np.flatnonzero(counts)
        yield table(p, at, counts[at])


def grid_cells(df: DataFrame, pairs: list[tuple[str, str]], bins: int = GRID_BINS) -> DataFrame:
    """(col_a, col_b, bin_a, bin_b, n), the occupied cells of every pair, from one scan.

    A row is binned once a column; each task fills the tables of all pairs (bins x bins cells) and hands on
    only these, so neither a row a pair nor the table is shuffled."""
    rng = ranges(df, sorted({c for p in pairs for c in p}))
    known = [(a, b) for a, b in pairs if a in rng and b in rng]
    if not known:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, bin_a int, bin_b int, n long")
    cols = sorted({c for p in known for c in p})
    at = [(cols.index(a), cols.index(b)) for a, b in known]
    coded = df.select(*[F.coalesce(binned(number(c), *rng[c], bins), F.lit(-1)).cast("long").alias(f"c{i}") for i, c in enumerate(cols)])

    def codes(batch):
        return [c.to_numpy() for c in batch.columns]
    counts = (coded.mapInArrow(lambda batches: _counted_pairs(batches, codes, [bins] * len(cols), at), "p int, x long, y long, n long")
              .groupBy("p", "x", "y").agg(F.sum("n").alias("n")))
    name = [F.array(*[F.lit(pair[k]) for pair in known])[F.col("p")] for k in (0, 1)]
    return counts.select(name[0].alias("col_a"), name[1].alias("col_b"), F.col("x").cast("int").alias("bin_a"),
                         F.col("y").cast("int").alias("bin_b"), "n")


def chi2_table(df: DataFrame, pairs: list[tuple[str, str]], bins: int = GRID_BINS) -> DataFrame:
    """Chi-square and Cramér's V of equal-width binned column pairs.

    chi2 = N * sum over occupied cells of n^2 / (nx * ny) - N, so the empty cells are not needed.
    Cramér's V is NULL where a column occupies one bin only.
    """
    pair = ["col_a", "col_b"]
    full = (grid_cells(df, pairs, bins)
            .withColumn("nx", F.sum("n").over(Window.partitionBy(*pair, "bin_a")))
            .withColumn("ny", F.sum("n").over(Window.partitionBy(*pair, "bin_b"))))
    s = full.groupBy(*pair).agg(F.sum(F.col("n") * F.col("n") / (F.col("nx") * F.col("ny"))).alias("s"),
                                F.sum("n").alias("N"), F.count_distinct("bin_a").alias("kx"),
                                F.count_distinct("bin_b").alias("ky"))
    chi2 = F.col("N") * F.col("s") - F.col("N")
    free = F.nullif(F.col("N") * (F.least("kx", "ky") - 1), F.lit(0))
    return s.select(*pair, F.round(chi2, 6).alias("chi2"), F.round(F.sqrt(chi2 / free), 6).alias("cramers_v"))


# ---------------------------------------------------------------- phi_k

def _edges(margin: np.ndarray) -> np.ndarray:
    """Edges on the standard normal that give each bin its observed share."""
    share = np.cumsum(margin)[:-1] / margin.sum()
    return np.array([-np.inf, *[NormalDist().inv_cdf(float(s)) for s in share], np.inf])


def _normal_cells(ex: np.ndarray, ey: np.ndarray, rho: float) -> np.ndarray:
    """Probability of each cell under a bivariate normal with correlation ``rho``.

    Inner corners: Phi(h) Phi(k) + 1/(2 pi) * integral over theta in (0, asin rho) of
    exp(-(h^2 + k^2 - 2 h k sin theta) / (2 cos^2 theta)), by Gauss-Legendre quadrature.
    """
    cdf = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2.0)))
    px, py = cdf(ex), cdf(ey)
    corner = np.minimum.outer(px, py) if rho >= 1.0 else np.outer(px, py)
    if 0.0 < rho < 1.0:
        node, weight = np.polynomial.legendre.leggauss(96)
        top = math.asin(rho)
        theta = top * (node + 1) / 2
        h, k = ex[1:-1, None, None], ey[None, 1:-1, None]
        f = np.exp(-(h * h + k * k - 2 * h * k * np.sin(theta)) / (2 * np.cos(theta) ** 2))
        corner[1:-1, 1:-1] += (f * weight).sum(axis=2) * top / 2 / (2 * math.pi)
    return np.clip(np.diff(np.diff(corner, axis=0), axis=1), 0.0, None)


def phik(table: np.ndarray) -> float:
    """phi_k (Baak et al. 2019) of a table of counts.

    The chi-square of a bivariate normal with the observed margins, scaled between the noise
    pedestal (the degrees of freedom) and the largest possible value, is inverted for rho. Empty
    rows and columns are left out; fewer than two occupied rows or columns give NaN.
    """
    m = np.asarray(table, dtype=float)
    m = m[m.sum(axis=1) > 0][:, m.sum(axis=0) > 0]
    if min(m.shape, default=0) < 2:
        return float("nan")
    n = m.sum()
    expected = np.outer(m.sum(axis=1), m.sum(axis=0)) / n
    chi2 = float(((m - expected) ** 2 / expected).sum())
    pedestal = float((m.shape[0] - 1) * (m.shape[1] - 1))
    largest = float(n * (min(m.shape) - 1))
    if chi2 <= pedestal:
        return 0.0
    if chi2 >= largest:
        return 1.0
    ex, ey = _edges(m.sum(axis=1)), _edges(m.sum(axis=0))

    def normal_chi2(rho):
        p = _normal_cells(ex, ey, rho) * n
        return float(((p - expected) ** 2 / expected).sum())

    scale = (largest - pedestal) / normal_chi2(1.0)
    lo, hi = 0.0, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if pedestal + scale * normal_chi2(mid) < chi2 else (lo, mid)
    return (lo + hi) / 2


def phik_matrix(df: DataFrame, pairs: list[tuple[str, str]], bins: int = GRID_BINS) -> DataFrame:
    """(col_a, col_b, phik), each pair's grid (at most bins x bins cells) evaluated in a task."""
    def one(cells: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((bins, bins))
        m[cells["bin_a"], cells["bin_b"]] = cells["n"]
        return pd.DataFrame({"col_a": cells["col_a"].iloc[:1], "col_b": cells["col_b"].iloc[:1],
                             "phik": [round(phik(m), 4)]})
    return grid_cells(df, pairs, bins).groupBy("col_a", "col_b").applyInPandas(
        one, "col_a string, col_b string, phik double")


# ---------------------------------------------------------------- Kendall

def with_running_sum(df: DataFrame, order: list[str], weight: str, out: str) -> DataFrame:
    """``out``: the sum of ``weight`` (whole numbers) over all rows earlier in ``order``, without a global sort task.

    Rows are range-partitioned, sorted and summed inside each partition as they pass, so they are shuffled once; one offset
    per partition is broadcast. The summed rows are checkpointed, so offsets and rows see the same ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id())
    at, names = ranged.columns.index(weight), [*ranged.columns, out]

    def summed(batches):
        upto = 0
        for batch in batches:
            weights = batch.column(at).to_numpy()
            ends = upto + np.cumsum(weights)
            if len(ends):
                upto = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - weights, pa.int64())], names=names)
    rows = cut_lineage(ranged.mapInArrow(summed, StructType(ranged.schema.fields + [StructField(out, LongType())])))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("__pid").agg(F.sum(weight).alias("__t"))
               .select("__pid", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off")))
    return (rows.join(F.broadcast(offsets), "__pid")
            .withColumn(out, F.col(out) + F.col("__off")).drop("__pid", "__off"))


def signed_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Concordant minus discordant pairs of weighted points; ties in x or y count for neither.

    Points are ordered by x. At each bit of y's rank, points that agree on the higher bits form a
    group; those with the bit set are larger than those without, and running sums count them.
    """
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order].astype(float)
    y = np.unique(y, return_inverse=True)[1][order]
    total = 0.0
    for bit in range(int(y.max(initial=0)).bit_length()):
        group = y >> (bit + 1)
        by = np.argsort(group, kind="stable")
        g, xs, w, one = group[by], x[by], n[by], (y[by] >> bit) & 1
        new_group = np.r_[True, g[1:] != g[:-1]]
        new_tie = new_group | np.r_[True, xs[1:] != xs[:-1]]
        at = np.arange(len(g))
        start = np.maximum.accumulate(np.where(new_group, at, 0))
        tie = np.maximum.accumulate(np.where(new_tie, at, 0))
        ones, zeros = np.r_[0.0, np.cumsum(w * one)], np.r_[0.0, np.cumsum(w * (1 - one))]
        total += float((w * np.where(one == 1, zeros[tie] - zeros[start], ones[start] - ones[tie])).sum())
    return total


def _signed_by(cells: DataFrame, keys: list[str]) -> DataFrame:
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        s = signed_pairs(rows["x"].to_numpy(), rows["y"].to_numpy(), rows["n"].to_numpy())
        return pd.DataFrame({"p": rows["p"].iloc[:1], "s": [s]})
    return cells.groupBy(*keys).applyInPandas(one, "p int, s double")


def _block_cuts(df: DataFrame, cols: list[str], size: int, rows: int) -> list[list[float]]:
    """Ascending cuts of each column between which at most about ``size`` rows lie. A cut is a value of the column; a
    value with more rows than that is always one. Quantile sketches: the cuts only share out work, any would be right."""
    blocks = -(-rows // size)
    probs = [k / blocks for k in range(1, blocks)]
    if not probs:
        return [[] for _ in cols]
    found = df.agg(*[F.percentile_approx(number(c), probs, max(10_000, 20 * blocks)) for c in cols]).first()
    return [sorted(set(f)) if f else [] for f in found]


def _block_of(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """2k: between cut k-1 and cut k, 2k+1: cut k itself, -1: no value."""
    at = np.searchsorted(cuts, values, side="left")
    equal = cuts[np.minimum(at, len(cuts) - 1)] == values if len(cuts) else np.zeros(len(values), bool)
    return np.where(np.isnan(values), -1, 2 * at + equal)


def _floats(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in batch.columns]


def _signed_total(cells: DataFrame, block_cells: int) -> DataFrame:
    """(p, s): signed pairs of cells(p, x, y, n) of whole numbered x and y."""
    total = cells.count()
    if total <= max(block_cells, COARSE_CELLS):
        return _signed_by(cells, ["p"])
    # blocks grow with the square root of the table, so that the table of blocks is always the smaller one
    size = max(block_cells, 4 * math.isqrt(total))

    def blocks(col):
        counts = cells.groupBy("p", col).agg(F.count(F.lit(1)).alias("cnt"))
        run = with_running_sum(counts, ["p", col], "cnt", "before")
        return run.select("p", col, (2 * F.floor(F.col("before") / F.lit(size)) + (F.col("cnt") > size).cast("long")).alias(f"{col}b"))
    c = cut_lineage(cells.join(blocks("x"), ["p", "x"]).join(blocks("y"), ["p", "y"]))
    # a block of one value holds only pairs tied in it
    in_x = _signed_by(c.filter(F.col("xb") % 2 == 0).select("p", "x", "y", "n", "xb"), ["p", "xb"])
    in_y = _signed_by(c.filter(F.col("yb") % 2 == 0).select("p", F.col("xb").alias("x"), "y", "n", "yb"), ["p", "yb"])
    coarse = cut_lineage(c.groupBy("p", F.col("xb").alias("x"), F.col("yb").alias("y")).agg(F.sum("n").alias("n")))
    return in_x.unionByName(in_y).unionByName(_signed_total(coarse, block_cells))


def _ties(values: np.ndarray) -> float:
    n = np.unique(values, return_counts=True)[1].astype(float)
    return float((n * (n - 1) / 2).sum())


def kendall_matrix(df: DataFrame, pairs: list[tuple[str, str]], block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(col_a, col_b, tau_b), exact for any number of distinct values.

    Every column's values are cut into blocks of about ``block_cells`` rows; a value with more rows is a block
    of its own. Two rows in one block of x are compared in that block's task, those in different blocks of x and one of y
    in the task of y's block, and all others through the table of blocks a pair, counted map-side. So a row is sent
    once a column, with all its values, whatever the number of pairs, and not for a value that is its own block: that one
    holds ties only, whose number the table of blocks gives. Blocks grow with the square root of the table once it has
    more than ``block_cells`` squared sixteenths of rows.
    A pair without values or with a constant column gives NULL.
    """
    spark = df.sparkSession
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    at = [(cols.index(a), cols.index(b)) for a, b in pairs]
    values = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = df.count()
    size = max(block_cells, min(rows // MOST_BLOCKS, 1_000_000), 4 * math.isqrt(rows))
    cuts = [np.array(c, float) for c in _block_cuts(df, cols, size, rows)]
    sizes = [2 * len(c) + 1 for c in cuts]

    def codes(batch):
        return [_block_of(v, c) for v, c in zip(_floats(batch), cuts)]

    def dealt(batches):
        """A row a column c whose block holds several values: its values where it is first of a pair, else blocks."""
        for batch in batches:
            exact = _floats(batch)
            coded = [_block_of(v, c) for v, c in zip(exact, cuts)]
            for c in range(len(cols)):
                mine = (coded[c] >= 0) & (coded[c] % 2 == 0)
                fields = [pa.array(np.full(int(mine.sum()), c, np.int32)), pa.array(coded[c][mine], pa.int64())]
                fields += [pa.array(v[mine], pa.float64()) for v in exact]
                fields += [pa.array(b[mine], pa.int32()) if (k, c) in at else pa.nulls(int(mine.sum()), pa.int32()) for k, b in enumerate(coded)]
                yield pa.RecordBatch.from_arrays(fields, names=names_of)
    kinds = ["c int", "b long"] + [f"v{i} double" for i in range(len(cols))] + [f"b{i} int" for i in range(len(cols))]
    names_of = [k.split()[0] for k in kinds]

    def in_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        c, found = int(key[0]), []
        own = rows[f"v{c}"].to_numpy()
        one = np.ones(len(own))
        for p, (i, j) in enumerate(at):
            if c in (i, j):
                both = ~np.isnan(rows[f"v{j if c == i else i}"].to_numpy())
                mine, other = own[both], (rows[f"v{j}"].to_numpy() if c == i else rows[f"b{i}"].to_numpy())[both]
                # two rows of one block of the first column have been compared there
                s = signed_pairs(mine, other, one[both]) if c == i else signed_pairs(other, mine, one[both])
                found.append((p, s, _ties(mine) if c == i else 0.0, _ties(mine) if c == j else 0.0))
        return pd.DataFrame(found, columns=["p", "s", "n1", "n2"])
    inside = values.mapInArrow(dealt, ", ".join(kinds)).groupBy("c", "b").applyInPandas(in_block, "p int, s double, n1 double, n2 double")
    coarse = cut_lineage(values.mapInArrow(lambda batches: _counted_pairs(batches, codes, sizes, at), "p int, x long, y long, n long")
                         .groupBy("p", "x", "y").agg(F.sum("n").alias("n")))

    def choose2(name, *keys):
        m = F.sum("n").cast("double")
        alone = coarse.filter(F.col(keys[0]) % 2 == 1) if keys else coarse   # ties in blocks of several values are counted there
        return (alone.groupBy("p", *keys).agg(m.alias("m")).groupBy("p")
                .agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias(name)))
    parts = inside.unionByName(_signed_total(coarse, block_cells), allowMissingColumns=True)
    for name, key in (("n1", "x"), ("n2", "y")):
        parts = parts.unionByName(choose2(name, key), allowMissingColumns=True)
    sums = parts.groupBy("p").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("s", "n1", "n2")])
    names = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "p int, col_a string, col_b string")
    base = F.sqrt((F.col("n0") - F.col("n1")) * (F.col("n0") - F.col("n2")))
    return (names.join(choose2("n0"), "p", "left").join(sums, "p", "left")
            .select("col_a", "col_b", F.round(F.col("s") / F.nullif(base, F.lit(0.0)), 6).alias("tau_b")))
