"""Periodic runs of words: recursive frequency splitting, then a lag scan of the segments that survive.

A run of period q holds every one of its words at least twice, so a word that occurs once in its segment
cannot be in a run: it splits the segment. The parts have fewer words, so words become rare in them; the
splitting is repeated until no segment changes, for all segments of a block of documents at a time. Of
ordinary prose nothing survives. A surviving segment is scanned at every lag up to half its length: hashes
of word windows, sampled so that each qualifying stretch holds a sampled window, propose places (about
m log m of them for m words), and each is compared word by word and extended as far as the period holds.

Documents are whole rows and never leave their task; no shuffle is needed. A block is BLOCK_WORDS words or
one longer document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.llm.common import columns

LEAST_RUN = 12             # words that a run has at least; it also has two periods at least
LEAST_TIMES = 2            # times that a word must occur in its segment: a run holds two whole periods
BLOCK_WORDS = 200_000
BLOCK_PROBES = 1 << 18     # window comparisons made at a time
RUN = "start long, length long, period long"
_SPANS = pa.list_(pa.struct([(c.split()[0], pa.int64()) for c in RUN.split(", ")]))


def frequency_segments(words: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the segments that frequency splitting leaves of documents of ``sizes`` words each."""
    at = np.arange(len(words))                          # words still in play, and the segment of each
    segment = np.repeat(np.arange(len(sizes)), sizes)
    kinds, stable = int(words.max(initial=0)) + 1, []
    while len(at):
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        length = np.diff(np.r_[first, len(at)])
        which = np.repeat(np.arange(len(first)), length)
        _, pair, times = np.unique(which * kinds + words[at], return_inverse=True, return_counts=True)
        rare = times[pair] < LEAST_TIMES
        split = np.bincount(which, weights=rare, minlength=len(first)) > 0
        stable += [(int(at[s]), int(at[s]) + int(n)) for s, n in zip(first[~split & (length >= LEAST_RUN)], length[~split & (length >= LEAST_RUN)])]
        keep = (split & (length >= LEAST_RUN))[which] & ~rare
        at, which = at[keep], which[keep]
        segment = np.cumsum(np.r_[False, (at[1:] != at[:-1] + 1) | (which[1:] != which[:-1])]) if len(at) else at
    return sorted(stable)


def _forward(words: np.ndarray, lag: int, at: int) -> int:
    """The first place from ``at`` on whose word differs from that ``lag`` words later."""
    end, step = len(words) - lag, 32
    while at < end:
        upto = min(end, at + step)
        same = words[at:upto] == words[at + lag:upto + lag]
        if not same.all():
            return at + int(same.argmin())
        at, step = upto, step * 2
    return end


def _backward(words: np.ndarray, lag: int, at: int) -> int:
    """The smallest start of a stretch up to ``at`` whose words equal those ``lag`` words later."""
    step = 32
    while at > 0:
        low = max(0, at - step)
        same = words[low:at] == words[low + lag:at + lag]
        if not same.all():
            return at - int(same[::-1].argmin())
        at, step = low, step * 2
    return 0


def _proposals(words: np.ndarray) -> Iterator[tuple[int, int]]:
    """(lag, place) where a sampled window equals the one a lag later, by ascending lag and place."""
    m = len(words)
    with np.errstate(over="ignore"):
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        power = np.cumprod(np.r_[np.uint64(1), np.full(m, 0xD6E8FEB86659FD93, dtype=np.uint64)], dtype=np.uint64)
        sums = np.r_[np.uint64(0), np.cumsum(mixed * power[:m], dtype=np.uint64)]
        lags = np.arange(1, m // 2 + 1)
        least = np.maximum(lags, LEAST_RUN - lags)      # words that match at the lag in a qualifying run, at least
        window = np.maximum(1, least // 2)
        step = least - window + 1                       # any ``least`` words in a row hold a sampled window
        probes = np.maximum(0, (m - lags - window) // step + 1)
        ends = np.cumsum(probes)
        low = 0
        while low < len(lags):
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + BLOCK_PROBES, side="right")))
            n = probes[low:high]
            lag, width = np.repeat(lags[low:high], n), np.repeat(window[low:high], n)
            place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * np.repeat(step[low:high], n)
            here = (sums[place + width] - sums[place]) * power[lag]
            there = sums[place + lag + width] - sums[place + lag]
            hits = np.flatnonzero(here == there)
            yield from zip(lag[hits].tolist(), place[hits].tolist())
            low = high


def lag_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of a segment, by start and period."""
    found: dict[tuple[int, int], int] = {}
    spans: list[tuple[int, int, int]] = []
    held = np.full(len(words), -1)                      # of the runs over a word, one of many periods
    at_lag = done = 0
    for lag, place in _proposals(words):
        if lag == at_lag and place < done:
            continue                                    # in the stretch just compared
        if held[place] >= 0:
            start, end, period = spans[held[place]]
            if lag % period == 0 and end - start >= 2 * lag and place + lag < end:
                continue                                # the same run at a multiple of its period
        if words[place] != words[place + lag]:
            continue                                    # equal hashes of unequal windows
        start, end = _backward(words, lag, place), _forward(words, lag, place)
        at_lag, done = lag, end
        if end - start >= max(lag, LEAST_RUN - lag) and (start, end + lag) not in found:
            found[start, end + lag] = lag               # lags ascend: the first is the smallest period
            spans.append((start, end + lag, lag))
            held[start:end + lag] = len(spans) - 1
    return sorted((s, e, q) for (s, e), q in found.items())


def runs_of(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each run of each document, by start and period."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    words = np.fromiter((numbers[w] for d in documents for w in d), dtype=np.int64, count=int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    runs: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for low, high in frequency_segments(words, sizes):
        k = int(np.searchsorted(first, low, side="right")) - 1
        base = low - int(first[k])
        runs[k] += [(base + s, e - s, q) for s, e, q in lag_scan(words[low:high])]
    return runs


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        gone[start + period:start + length] = True
    return b" ".join(w for w, g in zip(words, gone) if not g)


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, runs (array of start, length, period), collapsed: one row per input row.

    Words are `[^\\x20\\x09-\\x0D]+`, compared by their bytes; ``edit`` may change a document's words first.
    A null or empty text, or one of white space, has no words, no runs and an empty collapsed text. Repeated
    rows and null doc_ids are documents like any other; an empty table gives no rows; other columns of the
    input are left behind. Runs come by start, then period.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(block):
            ids, documents = [i for i, _ in block], [d for _, d in block]
            runs = runs_of(documents)
            spans = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(spans, _SPANS), pa.array([collapse(d, r) for d, r in zip(documents, runs)], pa.binary())],
                ["doc_id", "runs", "collapsed"])

        for batch in batches:
            block, held = [], 0
            for i, text in zip(batch.column(0), batch.column(1)):
                i, words = i.as_py(), (text.as_py() or b"").split()   # bytes split at ASCII white space alone
                block.append((i, edit(i, words) if edit else words))
                held += len(words)
                if held >= BLOCK_WORDS:
                    yield answer(block)
                    block, held = [], 0
            if block:
                yield answer(block)

    plain = columns(docs, doc_id="long", text="string").select("doc_id", F.col("text").cast("binary").alias("text"))
    found = plain.mapInArrow(search, f"doc_id long, runs array<struct<{RUN.replace(' long', ': bigint')}>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
