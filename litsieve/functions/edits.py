"""Bounded edit distance of long texts, for pairs that a join has proposed.

``levenshtein`` fills a band of cells one by one, which takes seconds for two books. Here the common ends are
taken off, the segments of the shorter text that the longer one lacks bound the distance from below (each edit
breaks one segment at most), and what is left is solved by furthest-reaching points (Ukkonen 1985): after e
edits, how far each diagonal can be followed. Work grows with the distance, not with the product of lengths;
all diagonals of a round are numpy vectors.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from litsieve.functions.columns import col_of
from litsieve.functions.similarity import EPS, max_edits

FEW_EDITS = 24        # found fastest along the diagonals
COLUMNS_FIRST = 4_000 # characters up to which the columns take no longer than the search for few edits
BLOCK = 512           # columns of the table for which letters are looked up at a time, beside the band's width


def _common(a: str, b: str) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n                     # a[:low] equal, a[:high] not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def too_many_missing(short: str, long: str, most: int) -> bool:
    """Whether more than ``most`` of the shorter text's segments do not occur in the longer one as near to their place as
    that many edits leave them."""
    q = min(12, 4 * len(short) // (5 * (most + 1)))
    if q < 2:
        return False
    more = len(long) - len(short)
    before, after, missing = (most - more) // 2, (most + more) // 2 + q, 0
    for i in range(0, len(short) - q + 1, q):
        if long.find(short[i:i + q], max(0, i - before), i + after) < 0:
            missing += 1
            if missing > most:
                return True
    return False


def bounded_distance(a: str, b: str, most: int) -> int | None:
    """Edit distance of a and b, None where it exceeds ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    at = _common(a, b)
    a, b = a[at:], b[at:]
    end = _common(a[::-1], b[::-1])
    a, b = a[:len(a) - end], b[:len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    if too_many_missing(a, b, most):
        return None
    few = min(most, FEW_EDITS)
    if few == most or len(a) > COLUMNS_FIRST:
        d = _furthest(a, b, few)
        if d is not None or few == most:
            return d
    return _columns(a, b, most)


def _columns(a: str, b: str, most: int) -> int | None:
    """Distance of two texts, a the shorter, by columns of the table (Myers 1999, Hyyro 2003), of which only the rows that a
    path of ``most`` edits can touch are computed: their steps are the bits of two numbers that slide down a row a
    column. None as soon as the rest of b cannot bring it down to ``most``."""
    m, n = len(a), len(b)
    below = min((most - (n - m)) // 2, m)      # rows below the diagonal that starts in the corner, and above it
    above = min(n - m + (most - (n - m)) // 2, n)
    width = below + above + 1
    full, last = (1 << width) - 1, 1 << (width - 1)
    up, down, d = ((1 << (below + 1)) - 1) << above, 0, below      # of the lowest row of the band
    limit, bit = most + n - m + below, last
    for start in range(0, n, BLOCK + width):
        at: dict[str, int] = {}
        base = start - above                   # the row of a at the band's first bit in the block's first column
        for i, c in enumerate(a[max(base, 0):max(base, 0) + BLOCK + 2 * width], max(base, 0) - base):
            at[c] = at.get(c, 0) | 1 << i
        for shift, c in enumerate(b[start:start + BLOCK + width]):
            same = (at.get(c, 0) >> shift) & full
            x = (((same & up) + up) ^ up) | same | down
            right, left = down | (full & ~(x | up)), x & up
            if start + shift < m - below:
                if not x & last:
                    d += 1
            else:
                bit >>= 1
                if right & bit:
                    d += 1
                elif left & bit:
                    d -= 1
            if d > limit:
                return None
            x = (x & full) >> 1
            up, down = left & full | (full & ~(x | right)), x & right
    return d if d <= most else None


def _packed(codes: np.ndarray, letters: int) -> tuple[np.ndarray, int]:
    """Every stretch of ``step`` codes as one integer, and that step."""
    step, bits = (8, 8) if letters < 255 else (4, 16) if letters < 65535 else (2, 32)
    out, end = np.zeros(len(codes), dtype=np.uint64), len(codes)
    for i in range(step):
        out[:end - i] |= codes[i:].astype(np.uint64) << np.uint64(bits * i)
    return out, step


def _furthest(a: str, b: str, most: int) -> int | None:
    """Distance of two texts, a the shorter, by rounds of one edit; None beyond ``most`` rounds."""
    m, n = len(a), len(b)
    both = np.frombuffer((a + b).encode("utf-32-le"), dtype=np.uint32)
    letters, codes = np.unique(both, return_inverse=True)
    pad = np.full(8, len(letters), dtype=codes.dtype)     # ends differ: no stretch runs over them
    rows, columns = np.concatenate((codes[:m], pad)), np.concatenate((codes[m:], pad + 1))
    row_blocks, step = _packed(rows, len(letters) + 2)
    column_blocks, _ = _packed(columns, len(letters) + 2)

    def follow(i: np.ndarray, d: np.ndarray) -> None:
        on = np.flatnonzero(rows[i] == columns[i + d])
        while True:
            at = i[on]
            more = row_blocks[at] == column_blocks[at + d[on]]
            if not more.any():
                break
            rest = on[~more]
            on = on[more]
            i[on] += step
            _single(rest, i, d)
        _single(on, i, d)

    def _single(on: np.ndarray, i: np.ndarray, d: np.ndarray) -> None:
        while on.size:
            on = on[rows[i[on]] == columns[i[on] + d[on]]]
            i[on] += 1

    goal = n - m
    reach = np.full(2 * most + 5, -2, dtype=np.int64)     # of diagonal d at d + most + 2
    for e in range(most + 1):
        low, high = max(-e, goal - (most - e), -m), min(e, goal + (most - e), n)
        d = np.arange(low, high + 1)
        if e == 0:
            i = np.zeros(1, dtype=np.int64)
            d = np.zeros(1, dtype=np.int64)
            low = high = 0
        else:
            at = slice(low + most + 2, high + most + 3)
            i = np.maximum(np.maximum(reach[at] + 1, reach[at.start - 1:at.stop - 1]), reach[at.start + 1:at.stop + 1] + 1)
            i = np.minimum(np.minimum(i, m), n - d)
        live = np.flatnonzero((i >= 0) & (i + d >= 0))
        sub = i[live]
        follow(sub, d[live])
        i[live] = sub
        reach[low + most + 2:high + most + 3] = i
        if low <= goal <= high and i[goal - low] >= m:
            return e
    return None


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([bounded_distance(x, y, int(k)) for x, y, k in zip(a, b, most)], dtype="Int32")


def long_ratio(a, b, threshold: float) -> Column:
    """D13 like ``bounded_ratio`` (NULL below the threshold), for texts of any length."""
    a, b = col_of(a), col_of(b)
    lmax = F.greatest(F.length(a), F.length(b))
    score = F.lit(100.0) * (F.lit(1.0) - _distance(a, b, max_edits(lmax, threshold)) / lmax)
    return F.when(lmax > 0, score)


@dataclass(frozen=True)
class Words:
    """A key and its words, as the scorers of D13 and D14 need them."""
    key: str
    in_order: str            # all words, sorted
    distinct: frozenset[str]
    length: int              # of the different words in a row, with blanks between them

    @classmethod
    def of(cls, key: str) -> Words:
        found = [w for w in re.split(r"[ \t\n\v\f\r]+", key) if w]
        distinct = frozenset(found)
        return cls(key, " ".join(sorted(found)), distinct, sum(map(len, distinct)) + max(0, len(distinct) - 1))


def _most(length: int, threshold: float) -> int:
    return int((100.0 - threshold) * length / 100.0 + EPS)


def _may_be_close(a: str, b: str, threshold: float, lost: int) -> bool:
    """Whether two texts of which one has ``lost`` different words that the other lacks can reach the threshold: an edit
    changes two words at most and breaks one segment."""
    if len(a) > len(b):
        a, b = b, a
    most = _most(len(b), threshold)
    return bool(b) and lost <= 2 * most and len(b) - len(a) <= most and not too_many_missing(a, b, most)


def _close(a: str, b: str, threshold: float, lost: int) -> float | None:
    """``bounded_ratio`` of two texts, ``lost`` as above."""
    longest = max(len(a), len(b))
    most = _most(longest, threshold)
    if not longest or lost > 2 * most:
        return None
    d = bounded_distance(a, b, most)
    score = None if d is None else 100.0 * (1.0 - d / longest)
    return score if score is not None and score >= threshold - EPS else None


def _token_set(a: Words, b: Words, threshold: float, close: Callable) -> float | None:
    """The parts of D14 by ``close``: the common words begin both texts, so of them alone only lengths count, and sorted
    texts are made only where their lengths allow the threshold."""
    common = a.distinct & b.distinct
    if common and len(common) in (len(a.distinct), len(b.distinct)):
        return 100.0
    found = []
    if common:
        start = sum(map(len, common)) + len(common) - 1
        for x in (a, b):
            score = 100.0 * (1.0 - (x.length - start) / x.length)
            if x.length - start <= _most(x.length, threshold) and score >= threshold - EPS:
                found.append(score)
    lost, longest = max(len(a.distinct), len(b.distinct)) - len(common), max(a.length, b.length)
    if abs(a.length - b.length) <= _most(longest, threshold) and lost <= 2 * _most(longest, threshold):
        first = sorted(common)
        score = close(*(" ".join([*first, *sorted(x.distinct - common)]) for x in (a, b)), threshold, lost)
        if score:
            found.append(float(score))
    return max(found, default=None)


def token_set_of(a: Words, b: Words, threshold: float) -> float | None:
    """``token_set_ratio`` of two long keys (None below the threshold)."""
    return _token_set(a, b, threshold, _close)


def composite_of(a: Words, b: Words, threshold: float) -> float | None:
    """``composite_score`` of two long keys (None below the threshold); distances are only taken where the words leave
    them a chance."""
    token = threshold / 0.95
    lost = max(len(a.distinct), len(b.distinct)) - len(a.distinct & b.distinct)
    best = _close(a.key, b.key, threshold, lost)
    for by_words in (token_set_of, lambda x, y, t: _close(x.in_order, y.in_order, t, lost)):
        if best is not None and best >= 95.0:
            break                             # as high as words can come
        score = by_words(a, b, token if best is None else max(token, best / 0.95))
        if score is not None:
            best = max(0.95 * score, best or 0.0)
    return best


def token_set_may(a: Words, b: Words, threshold: float) -> bool:
    """False only where ``token_set_of`` is None: no distance is taken."""
    return _token_set(a, b, threshold, _may_be_close) is not None


def composite_may(a: Words, b: Words, threshold: float) -> bool:
    token = threshold / 0.95
    return (token_set_may(a, b, token) or _may_be_close(a.key, b.key, threshold, 0) or _may_be_close(a.in_order, b.in_order, token, 0))
