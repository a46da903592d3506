"""Improbable-feature digests: rare byte windows in chained Bloom filters.

Every window of WINDOW bytes has an entropy, taken over eight byte classes and quantised to LEVELS steps. Digits
and the bytes of all other scripts are spread over the eight classes, so a text in any script has varied windows.
Levels are ranked by how rare they are over all windows of the corpus, the rarest first; levels of nearly
uniform windows carry no feature. Among each run of NEIGHBOURS windows the rarest (then leftmost) scores a
point, and a window with POINTS is a feature. Features enter Bloom filters of 2048 bits, a new one after
FEATURES. Likeness: each filter of the shorter digest is compared with all of the other, by the overlap of
bits beyond what chance gives, and the best values are averaged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.llm.common import columns, shuffle_width
from litsieve.llm.neighbours import BEFORE, OWN, Ranges, ranges_of

WINDOW, NEIGHBOURS, POINTS = 32, 32, 8
LEVELS = 1000
LEAST_LEVEL = 300          # of LEVELS; below, a window is nearly uniform
FEATURES, BITS, HASHES = 160, 2048, 5
BUFFER = 1 << 22
NEVER = 1 << 15
LOW_ID = -(1 << 63)

_CLASS = np.full(256, 7, dtype=np.uint8)
for _k, _group in enumerate((b" \t\n\r.,;:", b"eia", b"oun", b"trs", b"hldc", b"mpgfbwy", b"kvjqxz")):
    for _c in _group + _group.upper():
        _CLASS[_c] = _k
for _c in [*b"0123456789", *range(128, 256)]:
    _CLASS[_c] = _c & 7
_TERM = np.array([0.0] + [-c / WINDOW * np.log2(c / WINDOW) for c in range(1, WINDOW + 1)], dtype=np.float32)


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of the window that starts at each byte but the last WINDOW - 1."""
    kind, total = _CLASS[data], np.zeros(len(data) - WINDOW + 1, dtype=np.float32)
    sums = np.zeros(len(data) + 1, dtype=np.int32)
    for k in range(8):
        np.cumsum(kind == k, out=sums[1:])
        total += _TERM.take(sums[WINDOW:] - sums[:-WINDOW])
    return np.minimum((total * (LEVELS / 3)).astype(np.int32), LEVELS - 1)


def _level_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(LEVELS, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0):
            data = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
            for at in range(0, max(0, len(data) - WINDOW + 1), BUFFER):
                counts += np.bincount(levels(data[at:at + BUFFER + WINDOW - 1]), minlength=LEVELS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["level", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each level by its frequency over all windows of all texts (ties: the lower level), rarest 0;
    NEVER for levels below LEAST_LEVEL. At most LEVELS counts come to the driver."""
    counts = np.zeros(LEVELS, dtype=np.int64)
    for r in docs.select("text").mapInArrow(_level_counts, "level int, n long").groupBy("level").agg(F.sum("n")).collect():
        counts[r[0]] = r[1]
    rank = np.empty(LEVELS, dtype=np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(LEVELS)
    rank[:LEAST_LEVEL] = NEVER
    return rank


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _select(rank: np.ndarray) -> np.ndarray:
    """Places that are the rarest of at least POINTS of the runs of NEIGHBOURS places."""
    low = (rank.astype(np.int64) << 40) | np.arange(len(rank))
    step = 1
    while step < NEIGHBOURS:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    points = np.diff(np.concatenate((first, [len(low)])))
    best = low[first]
    return best[(points >= POINTS) & (best >> 40 < NEVER)] & ((1 << 40) - 1)


def features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Distinct feature hashes of each text in order; a text without any is one feature, an empty one none."""
    pad = NEIGHBOURS + WINDOW
    size = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(np.concatenate(([pad], size[:-1] + pad))) if len(texts) else size
    data = np.frombuffer(b"\0" * pad + b"".join(t + b"\0" * pad for t in texts), dtype=np.uint8)
    level = levels(data)
    at = np.full(len(level), NEVER, dtype=np.int64)
    inside = np.zeros(len(level) + 1, dtype=np.int32)
    whole = size >= WINDOW
    np.add.at(inside, start[whole], 1)
    np.add.at(inside, (start + size - WINDOW + 1)[whole], -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    at[inside] = rank[level[inside]]
    found = _select(at)
    words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[found].copy().view("<u8")
    mixed = np.zeros(len(found), dtype=np.uint64)
    for k in range(words.shape[1]):
        mixed = _mix(mixed + words[:, k] + np.uint64(0x9E3779B97F4A7C15))
    cut = np.searchsorted(found, start), np.searchsorted(found, start + size)
    out = []
    for k, text in enumerate(texts):
        own = mixed[cut[0][k]:cut[1][k]]
        if len(own) > 1:
            own = own[np.sort(np.unique(own, return_index=True)[1])]
        elif not len(own) and text:
            own = np.frombuffer(hashlib.sha256(text).digest()[:8], dtype="<u8")
        out.append(own)
    return out


def filters(own: np.ndarray) -> np.ndarray:
    """(filters, BITS) booleans: FEATURES features to a filter, HASHES bits each, from 11-bit parts of the hash."""
    out = np.zeros((-(-len(own) // FEATURES), BITS), dtype=bool)
    at = np.arange(len(own)) // FEATURES
    for k in range(HASHES):
        out[at, ((own >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return out


def text_of(bloom: np.ndarray) -> str:
    return np.packbits(bloom, axis=1).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; two empty digests are alike, an empty and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(b) < len(a):
        a, b = b, a
    best = np.zeros(len(a))
    count_a, count_b = a.sum(axis=1).astype(np.float64), b.sum(axis=1).astype(np.float64)
    for i in range(0, len(a), 256):
        for j in range(0, len(b), 256):
            both = a[i:i + 256].astype(np.float32) @ b[j:j + 256].astype(np.float32).T
            ca, cb = count_a[i:i + 256, None], count_b[None, j:j + 256]
            chance, most = ca * cb / BITS, np.minimum(ca, cb)
            part = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)
            best[i:i + 256] = np.maximum(best[i:i + 256], part.max(axis=1))
    return float(best.mean())


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _deal(batches: Iterator[pa.RecordBatch], ranges: Ranges) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        seats = [(k, r, s) for k, i in enumerate(ids) for r, s in ranges.places(LOW_ID if i is None else i) if s != BEFORE]
        rows, where, seat = zip(*seats) if seats else ((), (), ())
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(seat, pa.int32()), batch.column(0).take(take), texts.take(take)],
                                         names=["range", "seat", "doc_id", "text"])


class Digester:
    def __init__(self, rank: np.ndarray):
        self.rank = rank

    def rows(self, some: list[tuple]) -> pa.RecordBatch:
        """(doc_id, text, following text) -> result rows."""
        raw = [t.encode("utf-8", "surrogatepass") for _, t, _ in some]
        change = [edited(t, f).encode("utf-8", "surrogatepass") for _, t, f in some]
        after = some[-1][2].encode("utf-8", "surrogatepass")
        # rows come in order, so the text that follows is mostly the next row's own
        odd = [k for k, (x, f) in enumerate(zip(some[:-1], some[1:])) if x[2] is not f[1]]
        extra = [some[k][2].encode("utf-8", "surrogatepass") for k in odd] + [after]
        blooms = [filters(f) for f in features(raw + change + extra, self.rank)]
        n = len(some)
        own, changed, nexts = blooms[:n], blooms[n:2 * n], [*blooms[1:n], blooms[-1]]
        for k, b in zip(odd, blooms[2 * n:]):
            nexts[k] = b
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _, _ in some], pa.int64()), pa.array([len(t) for _, t, _ in some], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in change]), pa.array(list(map(text_of, own))), pa.array(list(map(text_of, changed))),
            pa.array(list(map(likeness, own, changed))), pa.array(list(map(likeness, own, nexts)))], names=RESULT_NAMES)

    def stream(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (range, seat, doc_id, text): each own row is followed by the next, or by the range's guest."""
        held, chars, open_row, where = [], 0, None, None
        for batch in batches:
            for r, seat, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if r == where and open_row is not None:
                    held.append((*open_row, text or ""))
                    chars += len(open_row[1])
                    open_row = None
                if open_row is not None:
                    raise ValueError(f"no row follows document {open_row[0]}")
                if seat == OWN:
                    open_row, where = (doc_id, text or ""), r
                if chars > BUFFER // 2:
                    yield self.rows(held)
                    held, chars = [], 0
        if open_row is not None:
            raise ValueError(f"no row follows document {open_row[0]}")
        if held:
            yield self.rows(held)


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> RESULT: one row per input row, whole texts.

    A null or empty text has the empty fingerprint (like another empty one: 1, like any other: 0); a text
    shorter than a window, or with uniform windows only, is one feature as a whole. Rows without doc_id come
    first; rows of one doc_id follow one another by text; the first row follows the last, so a single row is
    its own successor; an empty table gives no rows.
    """
    docs = columns(docs, doc_id="long", text="string")
    key = F.coalesce("doc_id", F.lit(LOW_ID))
    ranges = ranges_of(docs, key, circular=True)
    model = Digester(rarity(docs))
    dealt = docs.mapInArrow(lambda it: _deal(it, ranges), "range int, seat int, doc_id long, text string")
    placed = dealt.repartition(shuffle_width(docs), "range").sortWithinPartitions("range", "seat", "doc_id", "text")
    return placed.mapInArrow(model.stream, RESULT)
