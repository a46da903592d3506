"""Which rows can have a partner by a key, from a table of hash bins: of bounded size however large the table, so that
rows without one need not be shuffled to find that out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1 << 24


def hash_bin(col) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(BINS)).cast("int")


def among_bins(bins: DataFrame) -> Callable[..., Column]:
    """Whether a value's bin is among ``bins`` (column ``bin``): never false for a value that put it there."""
    held = np.zeros(BINS, dtype=bool)
    held[bins.select("bin").distinct().toArrow().column("bin").to_numpy()] = True
    bits = np.packbits(held)

    @F.arrow_udf("boolean")
    def among(bin_: pa.Array) -> pa.Array:
        at = bin_.to_numpy(zero_copy_only=False)
        return pa.array((bits[at >> 3] >> (7 - (at & 7))) & 1 == 1)

    return lambda col: among(hash_bin(col))


def repeated_bins(df: DataFrame, col: str) -> DataFrame:
    """Bins of the values of ``col`` that more than one row falls into."""
    return df.groupBy(hash_bin(col).alias("bin")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bin")
