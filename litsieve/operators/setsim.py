"""Word-set similarity joins.

``jaccard_pairs`` is exact: a prefix filter (Chaudhuri et al. 2006; Xiao et al. 2008). Words are
ordered rare-first by the frequency of their hash bin, each set is represented by its first
``n - ceil(t*n) + 1`` words, sets of like sizes meet in cells (cells.py), pairs pass a length and a
position filter, and every candidate is verified with the true Jaccard. Rare-first order keeps stop
words out of the prefixes; neither the words of whole sets nor the meetings are shuffled.

``lsh_pairs`` is the MinHash/LSH alternative: banded signatures, an equi-join on
(band, bucket), then the same exact verification, so it can miss pairs but never reports a
false one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from litsieve.constants import NUM_PERM
from litsieve.functions.similarity import EPS, minhash_signature
from litsieve.operators.bins import among_bins, hash_bin
from litsieve.operators.cells import COUNTERS, Index, mixed, pairs_by_cell
from litsieve.session import cut_lineage

FREQUENCY_BINS = 1 << 18


def size_band(n: Column, ratio: float) -> Column:
    """Logarithmic size band: sizes within ``ratio`` of each other differ by at most one band."""
    width = max(-math.log(ratio) * 1.000001, 0.001)
    return F.floor(F.log(n) / F.lit(width))


def _frequencies(hashed: DataFrame) -> np.ndarray:
    """How many words fall into each of FREQUENCY_BINS bins of word hashes: exact counts of all sets, of bounded size
    however large the vocabulary. Any order of the words is right for a prefix; this one puts rare bins first."""
    counts = hashed.select(F.explode("h").alias("h")).groupBy(F.pmod("h", F.lit(FREQUENCY_BINS)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("f"))
    out = np.zeros(FREQUENCY_BINS, dtype=np.int64)
    table = counts.toArrow()
    out[table.column("bin").to_numpy()] = table.column("f").to_numpy()
    return out


def prefix_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, ws): hashes of the first n - ceil(t*n) + 1 words of every set in rare-first order."""
    hashed = sets.select("id", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    frequency = _frequencies(hashed)

    @F.pandas_udf("array<bigint>")
    def rarest(h: pd.Series) -> pd.Series:
        def first(x):
            keep = len(x) - math.ceil(threshold * len(x) - EPS) + 1
            return x[np.lexsort((x, frequency[np.mod(x, FREQUENCY_BINS)]))[:keep]]
        return h.map(first)

    return cut_lineage(hashed.select("id", "n", rarest("h").alias("ws")))


def jaccard_prefix(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, w, rk): the words of ``prefix_sets``, a row each."""
    return prefix_rows(prefix_sets(sets, threshold))


def prefix_rows(prefixes: DataFrame) -> DataFrame:
    return prefixes.select("id", "n", F.posexplode("ws").alias("rk", "w")).select("id", "n", "w", (F.col("rk") + 1).alias("rk"))


def prefix_candidates(prefixes: DataFrame, threshold: float) -> DataFrame:
    """Distinct (id_a < id_b) sharing a prefix word, of sizes and positions that allow the threshold, where id_a's row
    has ``a`` and id_b's has ``b`` (rows without these columns have both).

    For the first common word of a true pair, the words after it bound the overlap; a pair is kept if any shared
    word passes. Of the two prefixes, every common word that stands in the one which ends first stands in the other
    too, so its other words are lost to the overlap: whichever ends first, the shared words and the longer rest bound
    it. No true pair is lost (equal hashes can only add candidates).
    """
    rows = prefixes if "a" in prefixes.columns else prefixes.withColumns({"a": F.lit(True), "b": F.lit(True)})
    rows = rows.withColumns({"band": size_band(F.col("n"), threshold), "weight": F.size("ws") * 8})
    share = threshold / (1.0 + threshold)

    def find(table, r, s):
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        is_a, is_b = table.column("a").to_numpy(zero_copy_only=False), table.column("b").to_numpy(zero_copy_only=False)
        lists = table.column("ws").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        starts, flat = lists.offsets.to_numpy()[:-1], lists.values.to_numpy()

        def words(rows):
            row = np.repeat(np.arange(len(rows)), lengths[rows])
            rank = np.arange(len(row)) - np.repeat(np.cumsum(lengths[rows]) - lengths[rows], lengths[rows])
            return row, rank, mixed(flat[starts[rows][row] + rank].view(np.uint64))

        if not len(r) or not len(s):
            return
        row, rank, keys = words(r)
        index = Index(keys)
        per = max(1, COUNTERS // len(r))
        for i in range(0, len(s), per):
            some = s[i:i + per]
            other, place, probes = words(some)
            met = np.zeros(len(r) * len(some), dtype=bool)
            shared = np.zeros(len(met), dtype=np.int32)
            for x, y in index.meet(probes):
                np.add.at(shared, row[x] * len(some) + other[y], 1)
                a, b = r[row[x]], some[other[y]]
                overlap = 1 + np.minimum(n[a] - 1 - rank[x], n[b] - 1 - place[y])
                good = (overlap >= share * (n[a] + n[b]) - EPS) & (n[a] >= threshold * n[b] - EPS)
                good &= (n[b] > n[a]) | ((n[b] == n[a]) & (ids[a] < ids[b]))
                first, second = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
                good &= is_a[first] & is_b[second]
                met[row[x][good] * len(some) + other[y][good]] = True
            code = np.flatnonzero(met)
            a, b = r[code // len(some)], some[code % len(some)]
            good = shared[code] + np.maximum(n[a] - lengths[a], n[b] - lengths[b]) >= share * (n[a] + n[b]) - EPS
            yield a[good], b[good]

    return pairs_by_cell(rows.select("id", "n", "ws", "a", "b", "band", "weight"), "band", "weight", find)


def jaccard_candidates(first: DataFrame, second: DataFrame, threshold: float) -> DataFrame:
    """``prefix_candidates`` of two tables of ``jaccard_prefix`` rows: id_a in the first, id_b in the second."""
    both = first.withColumns({"a": F.lit(True), "b": F.lit(False)}).unionByName(second.withColumns({"a": F.lit(False), "b": F.lit(True)}))
    sets = both.groupBy("id").agg(F.max("n").alias("n"), F.array_sort(F.collect_set(F.struct("rk", "w"))).getField("w").alias("ws"),
                                  F.max("a").alias("a"), F.max("b").alias("b"))
    return prefix_candidates(sets, threshold)


def jaccard_sets(items: DataFrame, id_col: str = "id", words_col: str = "words") -> DataFrame:
    return items.select(F.col(id_col).alias("id"), F.col(words_col).alias("words")).filter(F.size("words") > 0)


def jaccard_pairs(items: DataFrame, threshold: float, id_col: str = "id", words_col: str = "words") -> DataFrame:
    """All pairs (id_a < id_b) whose distinct-word sets have Jaccard >= threshold.

    items: one row per id with an array of distinct words. Empty sets never match.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    sets = jaccard_sets(items, id_col, words_col)
    return verify_jaccard(prefix_candidates(prefix_sets(sets, threshold), threshold), sets, threshold)


PAIRS_A_GROUP = 200_000


def pair_groups(cand: DataFrame, rows: DataFrame, size: int) -> tuple[GroupedData, GroupedData]:
    """Candidates (id_a, id_b, ...) and the rows (id, ...) that they name, to be cogrouped: about ``size`` pairs a group.

    Pairs are brought together by the smallest id that id_a is paired with, so that the rows of a group of copies are
    sent to one task once, not once a pair; large groups are cut by id_a. Rows in no pair are not sent at all.
    """
    cand = cut_lineage(cand)
    least = cand.groupBy(F.col("id_b").alias("id_a")).agg(F.min("id_a").alias("__least"))
    grouped = cand.join(least, "id_a", "left").withColumn("__group", F.coalesce("__least", "id_a"))
    parts = grouped.groupBy("__group").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("__parts"))
    grouped = grouped.join(parts, "__group").withColumn("__part", F.pmod(F.xxhash64("id_a"), F.col("__parts"))) \
        .select("__group", "__part", *cand.columns)
    ends = grouped.select(F.col("__group").alias("__of"), F.col("__part").alias("__in"), F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    among = among_bins(ends.select(hash_bin("id").alias("bin")))
    held = rows.filter(among("id")).join(ends, "id").select("__of", "__in", *rows.columns)
    return grouped.groupBy("__group", "__part"), held.groupBy("__of", "__in")


def verify_jaccard(cand: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The candidates (id_a, id_b) whose word sets reach the threshold, with it."""
    grouped, words = pair_groups(cand.select("id_a", "id_b"), sets.select("id", "words"), PAIRS_A_GROUP)

    def scored(key, pairs: pa.Table, held: pa.Table) -> pa.Table:
        known: dict[int, list[set]] = {}
        for id_, w in zip(held.column("id").to_pylist(), held.column("words").to_pylist()):
            known.setdefault(id_, []).append(set(w))
        out = []
        for x, y in zip(pairs.column("id_a").to_pylist(), pairs.column("id_b").to_pylist()):
            for a in known.get(x, ()):
                for b in known.get(y, ()):       # more than one where an id repeats
                    both = len(a & b)
                    score = both / (len(a) + len(b) - both)
                    if score >= threshold - EPS:
                        out.append((x, y, score))
        x, y, score = zip(*out) if out else ((), (), ())
        return pa.table({"id_a": pa.array(x, pa.int64()), "id_b": pa.array(y, pa.int64()), "jaccard": pa.array(score, pa.float64())})

    return grouped.cogroup(words).applyInArrow(scored, "id_a long, id_b long, jaccard double")


def lsh_banded(sets: DataFrame, bands: int = 16, rows: int = 8, seed: int = 1) -> DataFrame:
    """(id, band, bucket): one bucket hash per band of the MinHash signature."""
    sig = sets.select("id", minhash_signature(F.col("words"), bands * rows, seed).alias("sig"))
    return sig.select(
        "id",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                                 lambda i: F.xxhash64(F.slice(F.col("sig"), i * rows + 1, rows)))).alias("band", "bucket"))


def lsh_candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct (id_a < id_b) sharing a (band, bucket)."""
    a, b = first.alias("a"), second.alias("b")
    return (a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.bucket") == F.col("b.bucket"))
                   & (F.col("a.id") < F.col("b.id")))
            .select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct())


def lsh_pairs(items: DataFrame, threshold: float, bands: int = 16, rows: int = 8, id_col: str = "id",
              words_col: str = "words", seed: int = 1, verify: bool = True) -> DataFrame:
    """MinHash LSH candidates (bands x rows = permutations), verified by exact Jaccard.

    16 x 8 is the default: at Jaccard 0.85 it finds a pair with probability 1-(1-.85^8)^16 > 0.99.
    """
    sets = jaccard_sets(items, id_col, words_col)
    banded = lsh_banded(sets, bands, rows, seed)
    cand = lsh_candidates(banded, banded)
    if not verify:
        return cand
    return verify_jaccard(cand, sets, threshold)


def signature_table(items: DataFrame, num_perm: int = NUM_PERM, id_col: str = "id", words_col: str = "words",
                    seed: int = 1) -> DataFrame:
    """(id, sig) with ``num_perm`` MinHash values per set (empty set -> NULL minima)."""
    return items.select(F.col(id_col).alias("id"), minhash_signature(F.col(words_col), num_perm, seed).alias("sig"))
