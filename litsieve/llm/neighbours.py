"""Rows beside their neighbours in a global order, with one shuffle of the rows.

Keys are cut into ranges at boundaries from a bounded sample. The first and last key of every non-empty
range (two values a range) tell which rows a range must also see: they are sent twice, once as a guest of
the range before or after. Inside a range rows come sorted, so a single pass sees each row's neighbours,
and the result does not depend on where the boundaries fell.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.llm.common import shuffle_width

SAMPLE_PER_RANGE = 40
BEFORE, OWN, AFTER = 0, 1, 2


@dataclass
class Ranges:
    bounds: list
    seats: dict          # key -> [(range, BEFORE or AFTER)] where rows of this key are guests

    def places(self, key) -> list[tuple[int, int]]:
        return [(bisect_right(self.bounds, key), OWN), *self.seats.get(key, ())]


def ranges_of(keys: DataFrame, key: Column, circular: bool = False, ranges: int | None = None) -> Ranges:
    """Ranges of a non-null key column; ``circular``: the first row follows the last."""
    rows = keys.select(key.alias("key"))
    ranges = ranges or 2 * shuffle_width(rows)
    n = rows.count()
    if not n:
        return Ranges([], {})
    sample = sorted(r[0] for r in rows.sample(False, min(1.0, SAMPLE_PER_RANGE * ranges / n), seed=5).collect())
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []

    @F.pandas_udf("int")
    def range_of(column):
        return column.map(lambda x: bisect_right(bounds, x))

    ends = rows.groupBy(range_of("key").alias("range")).agg(F.min("key"), F.max("key")).collect()  # two keys a range
    ends = sorted(tuple(r) for r in ends)
    seats: dict = {}
    for (a, _, last), (b, first, _) in zip(ends, ends[1:]):
        seats.setdefault(first, []).append((a, AFTER))
        seats.setdefault(last, []).append((b, BEFORE))
    if circular:
        seats.setdefault(ends[0][1], []).append((ends[-1][0], AFTER))
        seats.setdefault(ends[-1][2], []).append((ends[0][0], BEFORE))
    return Ranges(bounds, seats)
