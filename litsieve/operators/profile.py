"""Table profile (E1-E16): the statistics of an explorative profiling report, as Spark jobs.

Every statistic is a distributed aggregate. The driver only sees bounded summaries: one row
per column, per column pair, per histogram bin or per bucket of a selection pass.

Exact quantiles use distributed selection (``select_ranks``): equal-width bucket counts narrow the
value range that holds each wanted rank, for all columns in the same scan, until the range holds few
enough values to number them; no task or driver ever holds a whole column. ``approx=True``
switches to ``percentile_approx`` (one pass, bounded sketch).
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, NumericType, StringType, StructType

from litsieve.operators.association import GRID_BINS, binned, grid_cells, number, ranges, with_running_sum
from litsieve.session import cut_lineage


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def _long(df: DataFrame, stats: dict[str, callable], cols: list[str], label: str = "column") -> DataFrame:
    """One wide aggregate, unpivoted to one row per column."""
    aggs = []
    for i, c in enumerate(cols):
        for name, fn in stats.items():
            aggs.append(fn(F.col(c)).alias(f"{name}__{i}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias(label), *[F.col(f"{name}__{i}").alias(name) for name in stats])
            for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ---------------------------------------------------------------- E1 overview

def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells (and %), duplicate rows (and %), type counts.

    One pipeline: group by all columns (combined map-side, so a row repeated a million times
    is one row after the partial aggregate), then one aggregate over the groups.
    """
    n_cols = len(df.columns)
    types = [f.dataType for f in df.schema.fields]
    n_num = sum(isinstance(t, NumericType) for t in types)
    n_text = sum(isinstance(t, StringType) for t in types)
    nulls = reduce(lambda x, y: x + y, [F.col(c).isNull().cast("long") for c in df.columns])
    # rows are grouped on a SHA-256 digest of their JSON form (NULL fields are omitted by name,
    # so NULL and '' stay distinct): 32-byte keys in the shuffle instead of whole rows
    # atomic values are cast to text first: JSON prints timestamps in milliseconds only
    atomic = {f.name: not isinstance(f.dataType, (ArrayType, BinaryType, MapType, StructType)) for f in df.schema.fields}
    digest = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if atomic[c] else F.col(c) for c in df.columns])), 256)
    groups = (df.select(digest.alias("__h"), nulls.alias("__nulls")).groupBy("__h")
              .agg(F.count(F.lit(1)).alias("__n"), F.max("__nulls").alias("__nulls")))
    tot = groups.agg(F.sum("__n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct_rows"),
                     F.sum(F.col("__n") * F.col("__nulls")).alias("n_missing_cells"))
    return tot.select(
        F.col("n_rows").cast("long").alias("n_rows"), F.lit(n_cols).alias("n_columns"),
        F.col("n_missing_cells").cast("long").alias("n_missing_cells"),
        F.round(100.0 * F.col("n_missing_cells") / F.nullif(F.col("n_rows") * n_cols, F.lit(0)), 6)
        .alias("missing_cells_pct"),
        (F.col("n_rows") - F.col("n_distinct_rows")).cast("long").alias("n_duplicate_rows"),
        F.round(100.0 * (F.col("n_rows") - F.col("n_distinct_rows")) / F.nullif(F.col("n_rows"), F.lit(0)), 6)
        .alias("duplicate_rows_pct"),
        F.lit(n_num).alias("n_numeric"), F.lit(n_text).alias("n_text"),
        F.lit(n_cols - n_num - n_text).alias("n_other"))


# ---------------------------------------------------------------- E2 numeric summary

GRID_BITS = 53  # sums are taken on a grid of 2**-53 of the column's largest magnitude, the rests on one as fine again
HALF_BITS = 26  # a grid number is split here, so that squares are sums of products that fit a long
NUMERIC_SCHEMA = ("column string, n long, n_missing long, n_nan long, n_distinct long, min double, max double, mean double, "
                  "std double, variance double, sum double, n_zeros long, n_negative long, range double, cv double")


def _cells(df: DataFrame, values: dict[str, Column], *extra) -> DataFrame:
    """Long form (column, v, ...): one row a cell, NULL and NaN left out. ``extra`` are functions of the
    column's name that give a further field."""
    fields = [F.struct(F.lit(c).alias("column"), F.when(~F.isnan(v), v).alias("v"), *[f(c) for f in extra])
              for c, v in values.items()]
    return df.select(F.explode(F.array(*fields)).alias("r")).select("r.*").filter(F.col("v").isNotNull())


def _doubles(cols: list[str]) -> dict[str, Column]:
    return {c: F.col(f"`{c}`").cast("double") for c in cols}


def _ends(df: DataFrame, values: dict[str, Column]) -> dict[str, tuple[float, float, int]]:
    """(smallest, largest, count) of the non-NULL, non-NaN values of each column that has any; one scan."""
    clean = [F.when(~F.isnan(v), v) for v in values.values()]
    r = df.agg(*[x for v in clean for x in (F.min(v), F.max(v), F.count(v))]).first()
    return {c: tuple(r[3 * i:3 * i + 3]) for i, c in enumerate(values) if r[3 * i + 2]}


def value_groups(df: DataFrame, cols: list[str], scale: dict[str, int]) -> DataFrame:
    """(column, v, exact, q, k): every distinct value of every column with its number of rows, in one long-form
    aggregate. ``q`` is the value times 2**scale as a whole number, ``rest`` what rounding left, times 2**53 (NULL
    for infinite values)."""
    values = _doubles(cols)
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def exact(i):  # doubles merge whole numbers beyond 2**53: those are told apart by their text, as are all decimals
        text, kind = F.col(f"`{cols[i]}`").cast("string"), kinds.get(cols[i])
        return (text if kind == "decimal" else F.when(F.abs(values[cols[i]]) >= F.lit(2.0 ** 53), text) if kind == "long"
                else F.lit(None).cast("string")).alias("exact")

    # only what tells values apart is shuffled; the rest is worked out once a distinct value
    groups = _cells(df, {i: values[c] for i, c in enumerate(cols)}, exact).groupBy("column", "v", "exact").agg(F.count(F.lit(1)).alias("k"))
    steps = F.array(*[F.lit(math.ldexp(1.0, scale[c])) for c in cols])
    scaled = F.when(F.abs("v") < F.lit(math.inf), F.col("v") * steps[F.col("column")])
    q, rest = F.rint("scaled"), F.rint((F.col("scaled") - F.rint("scaled")) * F.lit(math.ldexp(1.0, GRID_BITS)))
    return groups.withColumn("scaled", scaled).select(F.array(*[F.lit(c) for c in cols])[F.col("column")].alias("column"), "v", "exact",
                                                      q.cast("long").alias("q"), rest.cast("long").alias("rest"), "k")


def numeric_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per numeric column.

    NaN is counted apart (``n_nan``) and enters no other figure. Sums and squares are added as whole numbers on
    a grid of 2**-53 of the column's largest magnitude (sums with a second term for the rests), so mean, deviation and variance are the same for any
    order or split of the rows. A column with infinite values has no sum, mean, deviation, variance or cv;
    one without values has counts only. Two scans: ends and missing cells, then equal values of each column
    grouped (combined map-side), which also gives the exact distinct counts.
    """
    cols = cols or numeric_columns(df)
    values = _doubles(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], NUMERIC_SCHEMA)
    clean = {c: F.when(~F.isnan(v), v) for c, v in values.items()}
    finite = {c: F.when(F.abs(v) < F.lit(math.inf), F.abs(v)) for c, v in clean.items()}
    wide = df.agg(F.count(F.lit(1)), *[x for c in cols for x in (
        F.count(clean[c]), F.count(values[c]), F.min(clean[c]), F.max(clean[c]), F.max(finite[c]))]).first()
    first = {c: wide[1 + 5 * i:6 + 5 * i] for i, c in enumerate(cols)}
    # v * 2**scale is at most 2**53
    scale = {c: min(GRID_BITS - math.frexp(top)[1], 1000) if top else 0 for c, (_, _, _, _, top) in first.items()}
    groups = value_groups(df, cols, scale)
    whole = "decimal(19,0)"
    k, hi = F.col("k").cast(whole), F.shiftright("q", HALF_BITS)
    lo = F.col("q").bitwiseAND(F.lit((1 << HALF_BITS) - 1))
    stats = {r["column"]: r for r in groups.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.sum(F.when(F.col("v") == 0, F.col("k"))).alias("zeros"),
        F.sum(F.when(F.col("v") < 0, F.col("k"))).alias("negative"), F.count_if(F.col("q").isNull()).alias("endless"),
        F.sum(k * F.col("q").cast(whole)).alias("s"),
        F.sum(k * F.col("rest").cast(whole)).alias("rest"), F.sum(k * (hi * hi).cast(whole)).alias("hh"),
        F.sum(k * (hi * lo).cast(whole)).alias("hl"), F.sum(k * (lo * lo).cast(whole)).alias("ll")).collect()}  # a row a column
    rows = []
    for c in cols:
        n, present, least, most, _ = first[c]
        r = stats.get(c)
        row = [c, n, wide[0] - present, present - n, r["n_distinct"] if r else 0, least, most]
        mean = std = var = total = cv = None
        if r and not r["endless"]:
            step = Fraction(2) ** -scale[c]
            s1, s2 = int(r["s"]), (int(r["hh"]) << 2 * HALF_BITS) + (int(r["hl"]) << HALF_BITS + 1) + int(r["ll"])
            exact_sum = (s1 + Fraction(int(r["rest"]), 1 << GRID_BITS)) * step
            total, mean = float(round(exact_sum, 6)), exact_sum / n
            if n > 1:
                var = (n * s2 - s1 * s1) * step * step / (n * (n - 1))
                std = math.sqrt(var)
                cv = round(std / float(mean), 6) if mean else None
                std, var = round(std, 6), float(round(var, 6))
            mean = float(round(mean, 5))
        rows.append((*row, mean, std, var, total, (r["zeros"] or 0) if r else 0, (r["negative"] or 0) if r else 0,
                     None if least is None else most - least, cv))
    return df.sparkSession.createDataFrame(rows, NUMERIC_SCHEMA)


def moments(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Population skewness and excess kurtosis."""
    return _long(df, {"skewness": lambda c: F.round(F.skewness(c), 6),
                      "kurtosis": lambda c: F.round(F.kurtosis(c), 6)}, cols or numeric_columns(df))


def approx_distinct(df: DataFrame, cols: list[str] | None = None, rsd: float = 0.05) -> DataFrame:
    """HyperLogLog++ distinct counts (bounded memory per column)."""
    return _long(df, {"approx_distinct": lambda c: F.approx_count_distinct(c, rsd)}, cols or df.columns)


# ---------------------------------------------------------------- E3 quantiles

def _narrow(cells: DataFrame, spans: list[tuple], buckets: int) -> list:
    """One histogram round for all columns: per wanted rank the bucket that holds it.

    ``spans``: (column, rank, lo, hi, rows below lo), at most one row a wanted rank. They are broadcast:
    their number is that of columns times quantiles. Only the chosen buckets come back, a row a rank.
    """
    spark = cells.sparkSession
    wanted = spark.createDataFrame(spans, "column string, rank long, lo double, hi double, below long")
    ivs = []
    for c, lo, hi in sorted({(s[0], s[2], s[3]) for s in spans}):
        width = (hi - lo) / buckets
        ivs.append((c, lo, hi, width if width and math.isfinite(width) else None))
    ivs = spark.createDataFrame(ivs, "column string, lo double, hi double, width double")
    v, lo, hi, width = F.col("v"), F.col("lo"), F.col("hi"), F.col("width")
    # infinite ends, or values too close to divide: part the ends from the rest
    bucket = (F.when(width.isNull(), F.when(v == lo, 0).when(v == hi, 2).otherwise(1))
              .otherwise(F.least(F.floor((v - lo) / width), F.lit(buckets - 1)).cast("int")))
    hist = (cells.join(F.broadcast(ivs.withColumnRenamed("column", "__c")),
                       (F.col("column") == F.col("__c")) & (v >= lo) & (v <= hi))
            .groupBy("column", "lo", "hi", bucket.alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx")))
    upto = Window.partitionBy("column", "lo", "hi").orderBy("b")  # at most ``buckets`` rows
    ahead = F.sum("n").over(upto) - F.col("n")
    got = (hist.withColumn("ahead", ahead).join(F.broadcast(wanted), ["column", "lo", "hi"])
           .withColumn("ahead", F.col("ahead") + F.col("below"))
           .filter((F.col("rank") >= F.col("ahead")) & (F.col("rank") < F.col("ahead") + F.col("n"))))
    return got.select("column", "rank", "mn", "mx", "ahead", "n").collect()


def _numbered(cells: DataFrame, spans: list[tuple]) -> list:
    """The values at the wanted ranks of spans that hold few values each."""
    spark = cells.sparkSession
    wanted = spark.createDataFrame([(c, r, lo, hi, r - below) for c, r, lo, hi, below in spans],
                                   "column string, rank long, lo double, hi double, nth long")
    ivs = wanted.select(F.col("column").alias("__c"), "lo", "hi").distinct()
    inside = cells.join(F.broadcast(ivs), (F.col("column") == F.col("__c")) & F.col("v").between(F.col("lo"), F.col("hi")))
    # a span overlaps no other of its column, so each value is numbered once
    nth = (F.row_number().over(Window.partitionBy("column", "lo", "hi").orderBy("v")) - 1).cast("long")
    return (inside.select("column", "lo", "hi", "v", nth.alias("nth")).join(F.broadcast(wanted), ["column", "lo", "hi", "nth"])
            .select("column", "rank", "v").collect())


def select_ranks(df: DataFrame, values: dict[str, Column], ends: dict[str, tuple], ranks: dict[str, list[int]],
                 buckets: int = 2048, fetch_limit: int = 20_000) -> dict[tuple[str, int], float]:
    """Exact k-th smallest values (0-based ranks) of several columns by distributed range narrowing.

    Every round is one scan for all columns still open; the number of scans follows the values'
    distribution, not the number of columns. ``fetch_limit`` bounds the values numbered in one group.
    """
    out: dict[tuple[str, int], float] = {}
    spans = [(c, r, *ends[c][:2], 0) for c, rs in ranks.items() for r in rs]
    while True:
        out.update({(c, r): lo for c, r, lo, hi, _ in spans if lo == hi})
        spans = [s for s in spans if s[2] != s[3]]
        if not spans:
            return out
        cells = _cells(df, {c: values[c] for c in dict.fromkeys(s[0] for s in spans)})
        found = _narrow(cells, spans, buckets)
        if len(found) < len(spans):
            raise ValueError("a wanted rank is beyond the values of its column")
        few = [(g["column"], g["rank"], g["mn"], g["mx"], g["ahead"]) for g in found
               if g["n"] <= fetch_limit and g["mn"] != g["mx"]]
        if few:
            out.update({(g["column"], g["rank"]): g["v"] for g in _numbered(cells, few)})
        spans = [(g["column"], g["rank"], g["mn"], g["mx"], g["ahead"]) for g in found if (g["column"], g["rank"]) not in out]


def _quantiles(df: DataFrame, values: dict[str, Column], probs: list[float]) -> dict[str, dict[float, float]]:
    """Linear-interpolated quantiles (the usual 'type 7' / quantile_cont definition) of every column."""
    ends = _ends(df, values)
    place = {(c, p): (n - 1) * p for c, (_, _, n) in ends.items() for p in probs}
    ranks = {c: sorted({f(place[c, p]) for p in probs for f in (math.floor, math.ceil)}) for c in ends}
    got = select_ranks(df, values, ends, ranks)
    out = {c: dict.fromkeys(probs) for c in values}
    for (c, p), h in place.items():
        lo, hi = got[c, math.floor(h)], got[c, math.ceil(h)]
        out[c][p] = lo if lo == hi else lo + (h - math.floor(h)) * (hi - lo)
    return out


def order_statistics(df: DataFrame, col: str, ranks: list[int], buckets: int = 2048,
                     fetch_limit: int = 20_000) -> dict[int, float]:
    """``select_ranks`` of one column; None for every rank of a column without values."""
    values = _doubles([col])
    ends = _ends(df, values)
    if not ends:
        return {r: None for r in ranks}
    return {r: v for (_, r), v in select_ranks(df, values, ends, {col: ranks}, buckets, fetch_limit).items()}


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> dict[float, float]:
    """Linear-interpolated quantiles of one column; None where it has no values."""
    return _quantiles(df, _doubles([col]), probs)[col]


QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def quantile_summary(df: DataFrame, cols: list[str] | None = None, approx: bool = False,
                     accuracy: int = 10_000) -> DataFrame:
    """5/25/50/75/95 % quantiles, IQR and median absolute deviation per numeric column.

    All columns are selected together, then all deviations together. A column without values has NULLs.
    """
    cols = cols or numeric_columns(df)
    spark = df.sparkSession
    values = _doubles(cols)
    if approx:
        qs = {c: dict.fromkeys(QUANTILES) for c in cols}
        wide = df.agg(*[F.percentile_approx(F.when(~F.isnan(v), v), QUANTILES, accuracy) for v in values.values()]).first()
        qs.update({c: dict(zip(QUANTILES, got)) for c, got in zip(cols, wide) if got})
    else:
        qs = _quantiles(df, values, QUANTILES)
    away = {c: F.abs(values[c] - F.lit(qs[c][0.5])) for c in cols if qs[c][0.5] is not None}
    mads = dict.fromkeys(cols)
    if away and approx:
        wide = df.agg(*[F.percentile_approx(F.when(~F.isnan(v), v), 0.5, accuracy) for v in away.values()]).first()
        mads.update(zip(away, wide))
    elif away:
        mads.update({c: got[0.5] for c, got in _quantiles(df, away, [0.5]).items()})
    rows = [(c, *[qs[c][p] for p in QUANTILES], None if qs[c][0.5] is None else qs[c][0.75] - qs[c][0.25], mads[c])
            for c in cols]
    schema = "column string, p05 double, p25 double, p50 double, p75 double, p95 double, iqr double, mad double"
    out = spark.createDataFrame(rows, schema)
    return out.select("column", *[F.round(F.col(x), 6).alias(x) for x in out.columns[1:]])


# ---------------------------------------------------------------- E5-E8 correlations

def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def pearson_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """E5: Pearson r per column pair, one aggregate."""
    cols = cols or numeric_columns(df)
    pairs = _pairs(cols)
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.round(F.col(f"c{i}"), 6).alias("corr"))
            for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def average_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, v, off) for every distinct value of every column (by its place in ``cols``): its average rank
    (ties share it) less the column's mean rank.

    One pass for all columns: equal values are counted map-side, (column, value) pairs are range-partitioned
    and summed inside each partition; offsets a partition come from a small aggregate, so no single task
    sees a whole column. NULL and NaN have no rank.
    """
    dv = _cells(df, dict(enumerate(_doubles(cols).values()))).groupBy("column", "v").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = with_running_sum(dv, ["column", "v"], "cnt", "before")
    per_col = ranked.groupBy("column").agg(F.min("before").alias("base"), F.sum("cnt").alias("n"))  # one row a column
    rank = F.col("before") - F.col("base") + (F.col("cnt") + 1) / 2.0
    return ranked.join(F.broadcast(per_col), "column").select("column", "v", (rank - (F.col("n") + 1) / 2.0).alias("off"))


FEW_VALUES = 200_000  # ranks that are broadcast


def spearman_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Spearman rho = Pearson r of average ranks, over the rows where both columns have a value.

    A row stays whole: the ranks of a column of at most ``FEW_VALUES`` values are broadcast, those of any other are joined
    by one shuffle of the rows (salted where the value is missing, so missing ones are no hot key).
    """
    cols = cols or numeric_columns(df)
    pairs = _pairs(cols)
    values = _doubles(cols)
    clean = {c: F.when(~F.isnan(v), v) for c, v in values.items()}
    ranked = cut_lineage(average_ranks(df, cols))
    many = {r["column"]: r["n"] for r in ranked.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a column
    rows = df.select(*[v.alias(f"v{i}") for i, v in enumerate(clean.values())])
    for i in sorted(range(len(cols)), key=lambda i: many.get(i, 0)):
        table = ranked.filter(F.col("column") == i).select(F.col("v").alias("__v"), F.col("off").alias(f"r{i}"))
        if many.get(i, 0) <= FEW_VALUES:
            rows = rows.join(F.broadcast(table), F.col(f"v{i}") == F.col("__v"), "left")
        else:
            others = [c for c in rows.columns if c != f"v{i}"]
            salt = F.when(F.col(f"v{i}").isNull(), F.pmod(F.xxhash64(*others), F.lit(1024))).otherwise(F.lit(0).cast("long"))
            rows = rows.withColumn("__salt", salt).join(table.withColumn("__none", F.lit(0).cast("long")), (
                F.col(f"v{i}") == F.col("__v")) & (F.col("__salt") == F.col("__none")), "left")
        rows = rows.drop("__v", f"v{i}", "__salt", "__none")
    sums = []
    for a, b in pairs:
        x, y = F.col(f"r{cols.index(a)}"), F.col(f"r{cols.index(b)}")
        both = x.isNotNull() & y.isNotNull()
        sums += [F.sum(F.when(both, t)) for t in (F.lit(1.0), x, y, x * x, y * y, x * y)]
    wide = rows.agg(*sums).first()  # six sums a pair
    out = []
    for i, (a, b) in enumerate(pairs):
        n, sx, sy, sxx, syy, sxy = wide[6 * i:6 * i + 6]
        corr = None
        if n:
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            corr = round((sxy - sx * sy / n) / math.sqrt(vx * vy), 6) if vx > 0 and vy > 0 else None
        out.append((a, b, corr))
    return df.sparkSession.createDataFrame(out, "col_a string, col_b string, corr double")


# ---------------------------------------------------------------- E9, E14 histograms

def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = GRID_BINS) -> DataFrame:
    """Equal-width histogram per numeric column: (column, bin, lower, upper, n), one scan."""
    cols = cols or numeric_columns(df)
    rng = ranges(df, cols)
    entries = []
    for c in rng:
        lo, hi = rng[c]
        entries.append(F.struct(F.lit(c).alias("column"), binned(number(c), lo, hi, bins).alias("bin"), F.lit(lo).alias("lo"),
                                F.lit((hi - lo) / bins).alias("w")))
    if not entries:
        return df.sparkSession.createDataFrame([], "column string, bin int, lower double, upper double, n long")
    counts = (df.select(F.explode(F.array(*entries)).alias("r")).select("r.*").filter(F.col("bin").isNotNull())
              .groupBy("column", "bin", "lo", "w").agg(F.count(F.lit(1)).alias("n")))
    return counts.select("column", "bin", F.round(F.col("lo") + F.col("bin") * F.col("w"), 6).alias("lower"),
                         F.round(F.col("lo") + (F.col("bin") + 1) * F.col("w"), 6).alias("upper"), "n")


def interactions(df: DataFrame, cols: list[str] | None = None, bins: int = GRID_BINS) -> DataFrame:
    """2-D bin counts per numeric column pair."""
    return grid_cells(df, _pairs(cols or numeric_columns(df)), bins)


# ---------------------------------------------------------------- E10-E12 missing values

def missing_counts(df: DataFrame) -> DataFrame:
    """Missing count and percent per column."""
    return _long(df, {"n_missing": lambda c: F.count_if(c.isNull()),
                      "missing_pct": lambda c: F.round(100.0 * F.count_if(c.isNull()) / F.count(F.lit(1)), 6)},
                 df.columns)


def nullity_correlation(df: DataFrame) -> DataFrame:
    """Pearson r of the 0/1 missing indicators; columns that are never / always missing
    are left out (no variance)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns], F.count(F.lit(1)).alias("__n")).first()
    cols = [c for c in df.columns if 0 < counts[c] < counts["__n"]]
    ind = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in cols])
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    return pearson_matrix(ind, cols)


def nullity_distance(df: DataFrame) -> DataFrame:
    """Pairwise disagreement counts of missing indicators (the dendrogram's distance table)."""
    pairs = _pairs(df.columns)
    wide = df.agg(*[F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias(f"d{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"d{i}").alias("n_disagree"))
            for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def nullity_dendrogram(dist: DataFrame) -> list[tuple[str, str, float]]:
    """Average-linkage merge order of columns from the (columns x columns) distance table."""
    rows = dist.collect()  # one row per column pair
    clusters = {}
    d = {}
    for r in rows:
        clusters.setdefault(r["col_a"], 1)
        clusters.setdefault(r["col_b"], 1)
        d[frozenset((r["col_a"], r["col_b"]))] = float(r["n_disagree"])
    merges = []
    while len(clusters) > 1:
        key = min(d, key=lambda k: (d[k], sorted(k)))
        a, b = sorted(key)
        h = d.pop(key)
        new = f"({a},{b})"
        na, nb = clusters.pop(a), clusters.pop(b)
        for c in list(clusters):
            da = d.pop(frozenset((a, c)))
            db = d.pop(frozenset((b, c)))
            d[frozenset((new, c))] = (da * na + db * nb) / (na + nb)
        clusters[new] = na + nb
        merges.append((a, b, h))
    return merges


def nullity_merges(df: DataFrame) -> DataFrame:
    """The dendrogram of missing values as a table (step, left, right, height), nearest columns first, ties
    by name. Only the columns x columns distances come to the driver."""
    merges = [(i + 1, a, b, h) for i, (a, b, h) in enumerate(nullity_dendrogram(nullity_distance(df)))] if len(df.columns) > 1 else []
    return df.sparkSession.createDataFrame(merges, "step int, left string, right string, height double")


# ---------------------------------------------------------------- E13 text columns

def text_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Length min/mean/median/max, distinct and unique values, word counts and character classes.

    One scan for all columns: each (column, value) is measured map-side and grouped on the value's digest;
    totals weigh each value by its multiplicity. The median keeps one counter per distinct length. A column
    without any value gives no row.
    """
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in cols])).alias("c"))
    x = F.col("c.v")
    per_row = cells.filter(x.isNotNull()).select(
        "c.column", F.sha2(x, 256).alias("__h"), F.length(x).alias("len"),
        F.size(F.filter(F.split(x, r"\s+"), lambda w: w != F.lit(""))).alias("words"),
        F.regexp_count(x, F.lit(r"\p{L}")).alias("letters"), F.regexp_count(x, F.lit(r"\p{N}")).alias("digits"),
        F.regexp_count(x, F.lit(r"\s")).alias("spaces"), F.regexp_count(x, F.lit(r"\p{P}")).alias("punct"))
    stats = ["len", "words", "letters", "digits", "spaces", "punct"]
    per_value = per_row.groupBy("column", "__h").agg(F.count(F.lit(1)).alias("k"), *[F.max(s_).alias(s_) for s_ in stats])
    k = F.col("k")
    return per_value.groupBy("column").agg(
        F.sum(k).cast("long").alias("n"),
        F.min("len").alias("len_min"),
        F.round(F.sum(k * F.col("len")) / F.sum(k), 6).alias("len_mean"),
        F.percentile("len", 0.5, k).alias("len_median"),
        F.max("len").alias("len_max"),
        F.count(F.lit(1)).alias("n_distinct"), F.count_if(k == 1).alias("n_unique"),
        *[F.sum(k * F.col(s_)).cast("long").alias(f"n_{s_}") for s_ in stats[1:]],
    )


def top_values(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The k most frequent values (top-k report; ties by value)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "value").limit(k))


# ---------------------------------------------------------------- E15 alerts

def alerts(df: DataFrame, cols: list[str] | None = None, high_missing_pct: float = 20.0,
           high_cardinality: float = 0.5, high_corr: float = 0.9, skew_limit: float = 20.0) -> DataFrame:
    """Constant, high missing, high cardinality, zeros, skewed, highly correlated columns."""
    cols = cols or numeric_columns(df)
    pairs = _pairs(cols)
    wide = df.agg(*[F.round(F.skewness(c), 6) for c in cols], *[F.round(F.corr(a, b), 6) for a, b in pairs]).first()  # one scan
    spark = df.sparkSession
    skews = spark.createDataFrame([(c, wide[i]) for i, c in enumerate(cols)], "column string, skewness double")
    corrs = spark.createDataFrame([(a, b, wide[len(cols) + i]) for i, (a, b) in enumerate(pairs)], "col_a string, col_b string, corr double")
    summ = numeric_summary(df, cols).join(skews, "column")
    n = F.col("n") + F.col("n_missing")
    per_col = summ.select("column", F.explode(F.array(
        F.when(F.col("n_distinct") <= 1, F.lit("CONSTANT")),
        F.when(100.0 * F.col("n_missing") / n > high_missing_pct, F.lit("HIGH_MISSING")),
        F.when(F.col("n_distinct") > high_cardinality * n, F.lit("HIGH_CARDINALITY")),
        F.when(F.col("n_zeros") > 0.1 * n, F.lit("ZEROS")),
        F.when(F.abs("skewness") > skew_limit, F.lit("SKEWED")),
    )).alias("alert")).filter(F.col("alert").isNotNull()).select("column", "alert")
    corr = (corrs.filter(F.abs("corr") > high_corr)
            .select(F.concat_ws(" ~ ", "col_a", "col_b").alias("column"), F.lit("HIGH_CORRELATION").alias("alert")))
    return per_col.unionByName(corr)
