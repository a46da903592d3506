"""Edit-distance similarity join (D13, D15): all pairs with ratio >= T, without all-pairs.

Segments against grams (Li et al. 2011, Pass-Join; Qin et al. 2011, asymmetric signatures):

* ratio >= t needs lev <= (1-t)*Lmax and Lmin >= t*Lmax, so k(l) = floor((1-t)*l/t) bounds the edits
  between a key of length l and any partner as long or longer.
* the shorter key is cut into non-overlapping segments of q characters, more than k(l) of them. An edit
  breaks one segment at most, so of n segments n - k stand unchanged in the longer key, each moved
  by as many characters as edits in front of it allow.
* the segments are the index; every q-gram of the longer key is a probe. They meet on text and position
  bucket, inside a cell of two blocks of keys of like lengths (cells.py): no meeting is shuffled.
* pairs are counted per different shared segment; those with n - k or more are verified (functions/edits.py).

The shared count can only be too high (equal hashes), so no true pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.functions.edits import bounded_distance
from litsieve.functions.similarity import EPS
from litsieve.operators.bins import among_bins, hash_bin
from litsieve.operators.cells import COUNTERS, MEETINGS, mixed, pairs_by_cell
from litsieve.operators.setsim import size_band
from litsieve.session import cut_lineage

LONGEST_SEGMENT = 16
SKETCH = 4                 # least gram hashes of a key by which near copies find one another
GROUP_CHARS = 8_000_000    # of keys whose segments or grams are in memory at a time
GROUP_ROWS = 16_000
DENSE_BYTES = 48_000_000   # of the table of common segments
DENSE_FROM = 256           # common: held by one of so many keys


def segment_size(threshold: float) -> int:
    """Characters of a segment of long keys: eight ninths of the text that each edit leaves on average."""
    t = threshold / 100.0
    if t < 2.0 / 3.0:
        raise ValueError("edit-distance join needs a threshold of at least 67 (two thirds)")
    return LONGEST_SEGMENT if t >= 1.0 else max(2, min(LONGEST_SEGMENT, int(8 * t / (1.0 - t) / 9 + EPS)))


@lru_cache(maxsize=None)
def _long_from(threshold: float) -> int:
    """The length from which on every key has segments of the full size."""
    t, q = threshold / 100.0, segment_size(threshold)
    slack = 1.0 - q * (1.0 - t) / t                       # l - q*k(l) >= slack*l, and k + 1 segments need q more
    limit = int(q / slack) + 2 * q
    return max((n + 1 for n in range(1, limit + 1) if n // (int((1 - t) * n / t + EPS) + 1) < q), default=1)


def edit_keys(items: DataFrame, id_col: str = "id", key_col: str = "key") -> DataFrame:
    return (items.select(F.col(id_col).alias("id"), F.col(key_col).alias("key")).filter(F.length("key") > 0)
            .withColumns({"L": F.length("key"), "open": F.lit(True)}))


def _codes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all keys in a row, and where each begins (one more: the end)."""
    starts = np.zeros(len(keys) + 1, dtype=np.int64)
    np.cumsum([len(k) for k in keys], out=starts[1:])
    return np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def _gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q code points from each place on; those near the end run over it and mean nothing."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for j in range(q):
        h[:len(codes) - j] = h[:len(codes) - j] * np.uint64(0x100000001B3) + codes[j:]
    return mixed(h)


def _within(starts: np.ndarray, counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the row) of every step-th place, counts of them in each row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * step


def _runs(weights: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` of the weights together and of ``rows`` at most, one at least."""
    ends, i = np.cumsum(weights), 0
    while i < len(ends):
        j = max(i + 1, min(i + rows, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right"))))
        yield i, j
        i = j


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``starts`` and have ``counts`` places, one range after another."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _cell_candidates(threshold: float):
    """Finds the pairs of a cell that share as many segments as the edits must leave: r's keys are cut into
    segments, s's grams probe them. Groups of r's keys of like lengths meet those of s's that they can pair with."""
    t, most = threshold / 100.0, segment_size(threshold)

    def find(table, r, s):
        text, open_, ids = table.column("text"), table.column("open").to_numpy(zero_copy_only=False), table.column("id").to_numpy()
        long = table.column("L").to_numpy().astype(np.int64)
        raw, codec = table.column("bytes").to_numpy(), pa.Codec("zstd")

        def codes(rows):
            return _codes([codec.decompress(x, n, asbytes=True).decode("utf-8", "surrogatepass")
                           for x, n in zip(text.take(pa.array(rows)).to_pylist(), raw[rows].tolist())])

        # the edits to any partner of at least this length, and the segment size that leaves one segment more
        partner = np.floor((1.0 - t) * long / t + EPS).astype(np.int64)
        size = np.where(long >= _long_from(threshold), most, np.minimum(most, long // (partner + 1)))
        edits = np.floor((100.0 - threshold) * long / 100.0 + EPS).astype(np.int64)
        r, s = r[np.argsort(long[r], kind="stable")], s[np.argsort(long[s], kind="stable")]
        for q in np.unique(size[r]):
            rows = r[size[r] == q]
            for i, j in _runs(long[rows], GROUP_CHARS, GROUP_ROWS):
                some = rows[i:j]
                near = s[(long[s] >= long[some[0]]) & (t * long[s] - EPS <= long[some[-1]])]
                if len(near):
                    group = _Segments(*codes(some), int(q), int(edits[near].max()))
                    for a, b in _runs(long[near], GROUP_CHARS, max(1, COUNTERS // len(some))):
                        part = near[a:b]
                        low, high = np.searchsorted(long[part], long[some]), np.searchsorted(t * long[part] - EPS, long[some], side="right")
                        x, y = group.shared(*codes(part), edits[part], low, high)
                        good = (open_[some[x]] | open_[part[y]]) & ((long[part[y]] > long[some[x]]) | (ids[some[x]] < ids[part[y]]))
                        yield some[x[good]], part[y[good]]

    return find


class _Segments:
    """Segments of a group of keys (q characters each, cut one after another) and what finds them in longer keys.

    A place counts from the middle of its key and doubled, 2p - L: with k edits in all, an unchanged segment lies
    within k of its place in the shorter key. Segments stand in all buckets of k + 1 that such places can lie in.
    Shared segments are first counted by hash and bucket, which can only be too many, in a table of all pairs; for
    the pairs that reach what the edits must leave they are counted again by place.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, q: int, most: int):
        self.q, self.width, self.rows = q, most + 1, len(starts) - 1
        length = np.diff(starts)
        self.pieces = length // q
        self.row, place = _within(starts, self.pieces, q)
        self.hash = (_gram_hashes(codes, q)[starts[self.row] + place] >> np.uint64(32)) if len(self.row) else np.zeros(0, dtype=np.uint64)
        self.at = 2 * place - length[self.row]
        self.first = np.r_[0, np.cumsum(self.pieces)]
        low, high = (self.at - most) // self.width, (self.at + most) // self.width
        copies = high - low + 1
        segment = np.repeat(np.arange(len(low)), copies)
        bucket = np.repeat(low - (np.cumsum(copies) - copies), copies) + np.arange(len(segment))
        entries = self._keys(self.hash[segment], bucket) << np.uint64(32) | self.row[segment].astype(np.uint64)
        entries.sort()
        new = np.flatnonzero(np.r_[True, entries[1:] != entries[:-1]]) if len(entries) else np.zeros(0, dtype=np.int64)
        self.times = np.diff(np.r_[new, len(entries)])                     # a key's segments alike in a bucket
        keys, self.owner = entries[new] >> np.uint64(32), (entries[new] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
        self.keys, self.counts = keys[self.starts], np.diff(np.r_[self.starts, len(keys)])
        self.there = np.zeros(1 << 24, dtype=bool)
        self.there[self.keys >> np.uint64(8)] = True

    @staticmethod
    def _keys(hashes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        return mixed(hashes + buckets.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)

    def shared(self, codes: np.ndarray, starts: np.ndarray, edits: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in the group, number in the given keys) of the pairs that share pieces - edits segments; a key of the
        group is paired with those from its ``low`` to its ``high``."""
        length = np.diff(starts)
        row, place = _within(starts, np.maximum(length - self.q + 1, 0), 1)
        if not len(row) or not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        hashes, at = _gram_hashes(codes, self.q)[starts[row] + place] >> np.uint64(32), 2 * place - length[row]
        table = self._counted(hashes, at, row, low, high, len(length))
        found = [np.flatnonzero(table[i, a:b] >= self.pieces[i] - edits[a:b]) + a for i, (a, b) in enumerate(zip(low, high))]
        i, j = np.repeat(np.arange(self.rows), [len(x) for x in found]), np.concatenate(found)
        return self._by_place(i, j, hashes, at, np.searchsorted(row, np.arange(len(length) + 1)), edits)

    def _counted(self, hashes: np.ndarray, at: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
        keys = self._keys(hashes, at // self.width)
        hit = np.flatnonzero(self.there[keys >> np.uint64(8)])
        probes = np.sort(keys[hit] << np.uint64(32) | row[hit].astype(np.uint64))
        probes = probes[np.r_[True, probes[1:] != probes[:-1]]] if len(probes) else probes
        keys, owner = probes >> np.uint64(32), (probes & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.r_[starts, len(keys)])
        where = np.searchsorted(self.keys, keys[starts])
        where[where == len(self.keys)] = 0
        met = np.flatnonzero(self.keys[where] == keys[starts])
        starts, counts, where = starts[met], counts[met], where[met]
        table = np.zeros(self.rows * n, dtype=np.uint16)

        # what many keys hold is added up a whole row of keys at a time
        common = np.argsort(-counts, kind="stable")[:max(1, DENSE_BYTES // n)]
        common = common[counts[common] * DENSE_FROM >= n]
        holds = np.zeros((len(common), n), dtype=np.uint8)
        holds[np.repeat(np.arange(len(common)), counts[common]), owner[_spans(starts[common], counts[common])]] = 1
        entry = _spans(self.starts[where[common]], self.counts[where[common]])
        which = np.repeat(np.repeat(np.arange(len(common)), self.counts[where[common]]), self.times[entry])
        of = np.repeat(self.owner[entry], self.times[entry])
        order = np.argsort(of, kind="stable")
        which, ends = which[order], np.searchsorted(of[order], np.arange(self.rows + 1))
        whole = table.reshape(self.rows, n)
        for i in np.flatnonzero((np.diff(ends) > 0) & (high > low)):
            for a in range(ends[i], ends[i + 1], 255):
                whole[i, low[i]:high[i]] += np.add.reduce(holds[which[a:min(a + 255, ends[i + 1])], low[i]:high[i]], axis=0, dtype=np.uint8)

        rest = np.ones(len(starts), dtype=bool)
        rest[common] = False
        starts, counts, where = starts[rest], counts[rest], where[rest]
        for i, j in _runs(counts * self.counts[where], MEETINGS, len(counts)):
            entry = _spans(self.starts[where[i:j]], self.counts[where[i:j]])
            each = np.repeat(counts[i:j], self.counts[where[i:j]])
            other = owner[_spans(np.repeat(starts[i:j], self.counts[where[i:j]]), each)]
            np.add.at(table, np.repeat(self.owner[entry] * n, each) + other, np.repeat(self.times[entry], each).astype(np.uint16))
        return table.reshape(self.rows, n)

    def _by_place(self, i: np.ndarray, j: np.ndarray, hashes: np.ndarray, at: np.ndarray, first: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(j, kind="stable")
        i, j = i[order], j[order]
        good, ends = np.zeros(len(i), dtype=bool), np.searchsorted(j, np.arange(len(first)))
        middle = np.uint64(1 << 31)
        for y in np.flatnonzero(np.diff(ends)):
            grams = np.sort(hashes[first[y]:first[y + 1]] << np.uint64(32) | (at[first[y]:first[y + 1]].astype(np.uint64) + middle))
            k = int(edits[y])
            for a, b in _runs(self.pieces[i[ends[y]:ends[y + 1]]], MEETINGS, ends[y + 1] - ends[y]):
                pairs = i[ends[y] + a:ends[y] + b]
                segment = _spans(self.first[pairs], self.pieces[pairs])
                place = self.at[segment].astype(np.uint64) + middle
                found = np.searchsorted(grams, self.hash[segment] << np.uint64(32) | (place - np.uint64(k)))
                found[found == len(grams)] = 0
                same = (grams[found] >> np.uint64(32) == self.hash[segment]) & (np.abs((grams[found] & np.uint64(0xFFFFFFFF)).astype(np.int64) - place.astype(np.int64)) <= k)
                count = np.bincount(np.repeat(np.arange(len(pairs)), self.pieces[pairs]), weights=same, minlength=len(pairs))
                good[ends[y] + a:ends[y] + b] = count >= self.pieces[pairs] - k
        return i[good], j[good]


def _packed_keys(keys: DataFrame, band) -> DataFrame:
    """(id, text, bytes, L, open, band): keys as compressed bytes, for they are sent to several cells."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            raw = [k.encode("utf-8", "surrogatepass") for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary()),
                 pa.array([len(x) for x in raw], pa.int32()), batch.column("L"), batch.column("open"), batch.column("band")],
                ["id", "text", "bytes", "L", "open", "band"])

    rows = keys.select("id", "key", "L", "open", band.alias("band"))
    return rows.mapInArrow(pack, "id long, text binary, bytes int, L int, open boolean, band long")


def edit_candidates(keys: DataFrame, threshold: float) -> DataFrame:
    """(id_a < id_b), once each, that share as many segments as the edits must leave and of which one is open."""
    return pairs_by_cell(_packed_keys(keys, size_band(F.col("L"), threshold / 100.0)), "band", "L", _cell_candidates(threshold))


def edit_pairs(items: DataFrame, threshold: float, id_col: str = "id", key_col: str = "key") -> DataFrame:
    """All pairs (id_a < id_b) of non-empty keys with ratio >= threshold (0-100), with the score."""
    keys = edit_keys(items, id_col, key_col)
    return verify_edit_pairs(edit_candidates(keys, threshold), keys, threshold)


def verify_edit_pairs(cand: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """Candidates (id_a, id_b, ...) whose keys reach the threshold, with the score."""
    def ratio(x: str, y: str) -> float | None:
        longest = max(len(x), len(y))
        d = bounded_distance(x, y, int(((100.0 - float(threshold)) * longest) / 100.0 + EPS)) if longest else None
        return None if d is None else 100.0 * (1.0 - d / longest)

    return score_pairs(cand, keys, str, ratio)


def score_pairs(cand: DataFrame, keys: DataFrame, prepare: Callable, score: Callable) -> DataFrame:
    """Candidates (id_a, id_b, ...) with what ``score`` gives for their ``prepare``d keys; those for which it gives None go.
    Pairs are few and their keys long, so they are spread over all tasks by pair, not by what the joins on the ids leave;
    keys in no pair are not sent."""
    cand = cut_lineage(cand)
    among = among_bins(cand.select(F.explode(F.array("id_a", "id_b")).alias("id")).select(hash_bin("id").alias("bin")))
    keys = keys.select("id", "key").filter(among("id"))
    sized = cand.join(keys.select(F.col("id").alias("id_a"), F.col("key").alias("key_a")), "id_a") \
        .join(keys.select(F.col("id").alias("id_b"), F.col("key").alias("key_b")), "id_b")
    width = int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = sized.repartition(width, "id_a", "id_b")
    columns = ["id_a", "id_b", *[c for c in cand.columns if c not in ("id_a", "id_b")]]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # in one step: a filter on a scoring column would be pushed below the spreading and the score computed twice
        for batch in batches:
            known: dict = {}
            some, scores = [], []
            for i, pair in enumerate(zip(batch.column("key_a").to_pylist(), batch.column("key_b").to_pylist())):
                a, b = (known.get(k) or known.setdefault(k, prepare(k)) for k in pair)
                value = score(a, b)
                if value is not None:
                    some.append(i)
                    scores.append(value)
            kept = batch.select(columns).take(pa.array(some, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores, pa.float64())], [*kept.schema.names, "score"])

    return spread.mapInArrow(scored, cand.select(*columns).schema.add("score", "double"))


def rows_with_neighbours(items: DataFrame, threshold: float, id_col: str = "id", key_col: str = "key") -> DataFrame:
    """Ids of the keys that have any partner with ratio >= threshold (D18), without listing a group's pairs.

    First each key is compared with the smallest id that shares one of its SKETCH least gram hashes: at most
    SKETCH pairs a key, which settle the members of a group of near copies, however large. Only pairs of a key
    still open with any other are then joined and verified.
    """
    keys = edit_keys(items, id_col, key_col)
    grams = F.regexp_extract_all("key", F.lit(f"(?s)(?=(.{{{segment_size(threshold)}}}))"), F.lit(1))
    least = F.slice(F.array_sort(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g)))), 1, SKETCH)
    sketch = cut_lineage(keys.select("id", F.explode(least).alias("h")))
    heads = sketch.groupBy("h").agg(F.min("id").alias("head"))
    cand = sketch.join(heads, "h").filter("head <> id").select(F.col("head").alias("id_a"), F.col("id").alias("id_b")).distinct()
    settled = cut_lineage(_ends(verify_edit_pairs(cand, keys, threshold)))
    open_keys = keys.select("id").join(settled, "id", "left_anti").withColumn("still", F.lit(True))
    marked = keys.join(open_keys, "id", "left").withColumn("open", F.col("still").isNotNull()).drop("still")
    pairs = verify_edit_pairs(edit_candidates(marked, threshold), keys, threshold)
    return settled.union(_ends(pairs)).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
