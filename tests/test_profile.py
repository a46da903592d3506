import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from litsieve.operators import association as ac
from litsieve.operators import profile as pf


def _numbers(spark):
    rnd = random.Random(5)
    data = [(float(rnd.randint(0, 20)), rnd.random() * 100 - 30, float(i % 7)) for i in range(2000)]
    data += [(5.0, 1.0, 3.0)] * 700  # a hot value holding a quarter of the rows
    return spark.createDataFrame(data, "a double, b double, c double"), np.array(data)


def test_exact_quantiles_match_numpy(spark):
    df, arr = _numbers(spark)
    for j, col in enumerate("abc"):
        got = pf.exact_quantiles(df, col, [0.05, 0.25, 0.5, 0.75, 0.95])
        for p, v in got.items():
            assert abs(v - np.quantile(arr[:, j], p)) < 1e-9


def test_order_statistics_small_fetch_limit(spark):
    df, arr = _numbers(spark)
    ranks = [0, 17, 1349, 2699]
    got = pf.order_statistics(df, "b", ranks, buckets=4, fetch_limit=50)
    want = np.sort(arr[:, 1])
    assert [got[r] for r in ranks] == [want[r] for r in ranks]


def test_quantiles_of_all_columns_together(spark):
    df, arr = _numbers(spark)
    wide = df.select("a", "b", "c", (df.b * 3).alias("d"), (df.b - 7).alias("e"), F.lit(None).cast("double").alias("none"),
                     F.when(df.a > 3, df.b).otherwise(float("nan")).alias("part"))
    got = {r["column"]: r for r in pf.quantile_summary(wide).collect()}
    part = arr[arr[:, 0] > 3, 1]
    for c, v in {"a": arr[:, 0], "b": arr[:, 1], "c": arr[:, 2], "d": arr[:, 1] * 3, "e": arr[:, 1] - 7, "part": part}.items():
        want = [*np.quantile(v, pf.QUANTILES), np.subtract(*np.quantile(v, [0.75, 0.25])), np.median(abs(v - np.median(v)))]
        assert np.allclose(list(got[c])[1:], want, atol=2e-6), c
    assert list(got["none"])[1:] == [None] * 7
    near = {r["column"]: r for r in pf.quantile_summary(wide, approx=True).collect()}
    assert abs(near["b"]["p50"] - got["b"]["p50"]) < 1 and near["none"]["mad"] is None


def test_quantile_jobs_do_not_grow_with_columns(spark):
    df, _ = _numbers(spark)
    sc, jobs = spark.sparkContext, []
    for k in (1, 6):
        sc.setJobGroup(f"quantiles-{k}", "")
        pf.quantile_summary(df.select(*[(df.b * (i + 1)).alias(f"x{i}") for i in range(k)]))
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"quantiles-{k}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_numeric_summary_is_exact_in_any_order(spark):
    rnd = np.random.default_rng(8)
    v = np.r_[rnd.normal(size=3000) * 10.0 ** rnd.integers(-6, 9, 3000), np.zeros(40), np.full(1500, 0.1)]
    data = [(float(x), 2 ** 53 + i % 3, None) for i, x in enumerate(v)] + [(float("nan"), 1, None), (None, 1, None)]
    schema = "x double, big long, none double"
    got = [pf.numeric_summary(spark.createDataFrame(rows, schema).repartition(parts)).collect()
           for rows, parts in ((data, 3), (data[::-1], 7))]
    assert got[0] == got[1]
    x, big, none = got[0]
    exact = [Fraction(float(t)) for t in v]
    mean = sum(exact) / len(v)
    var = sum((t - mean) ** 2 for t in exact) / (len(v) - 1)
    assert math.isclose(x["sum"], float(sum(exact)), rel_tol=1e-14) and math.isclose(x["variance"], float(var), rel_tol=1e-14)
    assert abs(x["std"] - math.sqrt(var)) < 1e-6
    assert (x["n"], x["n_nan"], x["n_missing"], x["n_zeros"], x["n_negative"]) == (len(v), 1, 1, 40, int((v < 0).sum()))
    assert x["n_distinct"] == len(set(v)) and (x["min"], x["max"]) == (v.min(), v.max())
    assert big["n_distinct"] == 4  # neighbours beyond 2**53 are told apart
    assert (none["n"], none["n_missing"], none["n_distinct"], none["mean"]) == (0, len(data), 0, None)
    ends = pf.numeric_summary(spark.createDataFrame([(float("inf"),), (1.0,)], "x double")).first()
    assert (ends["n"], ends["max"], ends["sum"], ends["variance"]) == (2, float("inf"), None, None)
    assert pf.numeric_summary(spark.createDataFrame([], "x double")).first()["n"] == 0


def _tau_b(x, y):
    dx, dy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
    return (dx * dy).sum() / np.sqrt((dx != 0).sum() * float((dy != 0).sum()))


def test_kendall_matches_brute_force(spark):
    rnd = np.random.default_rng(2)
    x = np.exp(rnd.normal(size=1500))
    data = np.column_stack([x, x * np.exp(rnd.normal(size=1500)), rnd.integers(0, 6, 1500), np.full(1500, 3.0)])
    data[:500, 1] = 1.0  # a value held by a third of the rows
    df = spark.createDataFrame(data.tolist(), "a double, b double, c double, k double")
    df = df.union(spark.createDataFrame([(None, 1.0, 2.0, 3.0), (float("nan"), 1.0, 2.0, 3.0)], df.schema))
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("a", "k")]
    full = np.vstack([data, [[np.nan, 1, 2, 3]] * 2])
    col = {c: i for i, c in enumerate("abck")}
    for block_cells in (100, ac.BLOCK_CELLS):  # many blocks and one block give the same exact value
        got = {(r["col_a"], r["col_b"]): r["tau_b"] for r in ac.kendall_matrix(df, pairs, block_cells).collect()}
        assert got.pop(("a", "k")) is None
        for p, tau in got.items():
            v = full[:, [col[p[0]], col[p[1]]]]
            v = v[~np.isnan(v).any(axis=1)]
            assert abs(tau - _tau_b(v[:, 0], v[:, 1])) < 1e-6, p
    assert [r["tau_b"] for r in ac.kendall_matrix(df.limit(0), pairs[:1]).collect()] == [None]


def test_phik_of_known_tables():
    edges = np.linspace(-2, 2, 9)
    e = np.r_[-np.inf, edges, np.inf]
    for rho in (0.3, 0.6, 0.9):
        table = ac._normal_cells(e, e, rho) * 1e9  # noise is negligible beside a billion rows
        assert abs(ac.phik(table) - rho) < 0.001
    assert ac.phik(np.eye(5) * 100) == 1.0
    assert ac.phik(np.full((10, 10), 60)) == 0.0
    noise = np.random.default_rng(3).multinomial(600, np.full(100, 0.01)).reshape(10, 10)
    assert ac.phik(noise) < 0.25  # a table of independent columns stays near zero
    assert np.isnan(ac.phik(np.array([[5, 7]])))


def test_grids_ignore_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, 2), (float("nan"), 3), (None, 4), (2.0, None), (3.0, 9)], "x double, y int")
    assert sum(r["n"] for r in ac.grid_cells(df, [("x", "y")]).collect()) == 2
    h = pf.histogram(df).groupBy("column").sum("n").collect()
    assert {r[0]: r[1] for r in h} == {"x": 3, "y": 4}
    assert pf.histogram(df.limit(0)).count() == 0


def test_spearman_with_ties(spark):
    df, arr = _numbers(spark)
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in pf.spearman_matrix(df, ["a", "c"]).collect()}

    def avg_rank(v):
        order = np.argsort(v, kind="mergesort")
        ranks = np.empty(len(v))
        ranks[order] = np.arange(1, len(v) + 1)
        for u in np.unique(v):
            m = v == u
            ranks[m] = ranks[m].mean()
        return ranks
    want = np.corrcoef(avg_rank(arr[:, 0]), avg_rank(arr[:, 2]))[0, 1]
    assert abs(got[("a", "c")] - round(want, 6)) < 1e-6


def test_spearman_leaves_out_missing_values(spark):
    rnd = np.random.default_rng(4)
    data = rnd.integers(0, 9, size=(800, 3)).astype(float)
    data[:, 2] += data[:, 0]
    data[rnd.random(data.shape) < 0.2] = np.nan
    rows = [tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(data)] + [(1.0, -0.0, 0.0)] * 400
    full = np.vstack([data, [[1.0, 0.0, 0.0]] * 400])
    df = spark.createDataFrame(rows, "a double, b double, c double").withColumn("same", F.lit(2))
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in pf.spearman_matrix(df).collect()}
    ranks = pd.DataFrame(full).rank().to_numpy()  # ranked over the column's own values, NaN left out
    for i, j in ((0, 1), (0, 2), (1, 2)):
        both = ~np.isnan(ranks[:, [i, j]]).any(axis=1)
        want = np.corrcoef(ranks[both, i], ranks[both, j])[0, 1]
        assert abs(got["abc"[i], "abc"[j]] - want) < 2e-6
    assert got["a", "same"] is None
    assert pf.spearman_matrix(df.limit(0), ["a", "b"]).first()["corr"] is None


def test_overview_and_missing(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    o = pf.overview(df).first()
    assert (o["n_rows"], o["n_missing_cells"], o["n_duplicate_rows"], o["n_numeric"], o["n_text"]) == (3, 2, 1, 1, 1)
    m = {r["column"]: r["n_missing"] for r in pf.missing_counts(df).collect()}
    assert m == {"a": 0, "b": 2}


def test_histogram_counts_sum(spark):
    df, arr = _numbers(spark)
    h = pf.histogram(df, ["b"], bins=10).collect()
    assert sum(r["n"] for r in h) == len(arr)
    assert max(r["bin"] for r in h) == 9


def test_nullity_dendrogram(spark):
    df = spark.createDataFrame([(None, None, 1), (1, None, 1), (None, None, None)], "a int, b int, c int")
    merges = pf.nullity_dendrogram(pf.nullity_distance(df))
    assert len(merges) == 2


def test_nullity_merges_as_a_table(spark):
    # distances: ab 0, ac 2, bc 2, ad 4, bd 4, cd 2
    df = spark.createDataFrame([(None, None, None, 1), (None, None, None, 1), (1, 1, None, None), (1, 1, None, None)],
                               "a int, b int, c int, d int")
    got = [tuple(r) for r in pf.nullity_merges(df).orderBy("step").collect()]
    assert got == [(1, "a", "b", 0.0), (2, "(a,b)", "c", 2.0), (3, "((a,b),c)", "d", 10 / 3)]
    assert pf.nullity_merges(df.select("a")).count() == 0


def test_grids_send_counts_not_rows(spark):
    """no row a column pair; what tasks hand on is bounded by the cells."""
    df = spark.range(0, 20_000, 1, 3).selectExpr("id % 50 AS a", "id % 7 AS b", "CASE WHEN id % 3 > 0 THEN id END AS c")
    got = ac.grid_cells(df, [("a", "b"), ("b", "c"), ("a", "c")])
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    per = {(r["col_a"], r["col_b"]): r["s"] for r in got.groupBy("col_a", "col_b").agg(F.sum("n").alias("s")).collect()}
    with_c = df.filter("c IS NOT NULL").count()
    assert per == {("a", "b"): 20_000, ("b", "c"): with_c, ("a", "c"): with_c}


def test_pair_counts_by_table_and_by_sorting(monkeypatch):
    import pyarrow as pa
    rnd = np.random.default_rng(4)
    codes = [rnd.integers(-1, 30, 5000), rnd.integers(-1, 5, 5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in codes], names=["x", "y"])
    ok = (codes[0] >= 0) & (codes[1] >= 0)
    want = pd.Series(1, [codes[0][ok], codes[1][ok]]).groupby(level=[0, 1]).sum().to_dict()
    for cells in (0, 1 << 20):
        monkeypatch.setattr(ac, "DENSE_CELLS", cells)
        monkeypatch.setattr(ac, "SORTED_ROWS", 6000)
        found = pd.concat([b.to_pandas() for b in ac._counted_pairs(
            iter([batch, batch]), lambda b: [c.to_numpy() for c in b.columns], [30, 5], [(0, 1)])])
        assert (found.groupby(["x", "y"])["n"].sum() // 2).to_dict() == want


def test_kendall_sends_a_row_once_a_column(spark):
    """columns of few values send no row at all, others one a column whatever the number of pairs."""
    rnd = np.random.default_rng(6)
    data = np.column_stack([rnd.integers(0, 4, 3000), rnd.integers(0, 9, 3000), rnd.normal(size=3000).round(2)])
    df = spark.createDataFrame(data.tolist(), "a double, b double, c double").repartition(3)
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    few = [ac._block_of(data[:, i], np.array(ac._block_cuts(df, ["a", "b"], 100, 3000)[i])) for i in (0, 1)]
    assert all((b % 2 == 1).all() for b in few)   # every value is a block of its own
    for r in ac.kendall_matrix(df, pairs, 100).collect():
        assert abs(r["tau_b"] - _tau_b(data[:, "abc".index(r["col_a"])], data[:, "abc".index(r["col_b"])])) < 1e-6


def test_running_sum_shuffles_rows_once(spark):
    """sums are taken as sorted rows pass; the rows are not brought together by partition again."""
    rnd = random.Random(7)
    data = [(rnd.randint(0, 50), i, rnd.randint(1, 9)) for i in range(500)]
    got = ac.with_running_sum(spark.createDataFrame(data, "k int, i int, w long"), ["k", "i"], "w", "before")
    assert "Window [sum" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    before, want = 0, {}
    for k, i, w in sorted(data):
        want[i], before = before, before + w
    assert {r["i"]: r["before"] for r in got.collect()} == want


def test_spearman_joins_ranks_to_whole_rows(spark, monkeypatch):
    """the same figures whether a column's ranks are broadcast or joined by a shuffle; missing values take no part."""
    rnd = random.Random(11)
    data = [(None if i % 5 == 0 else float(rnd.randint(0, 30)), None if i % 7 == 0 else rnd.random(), float(i % 3)) for i in range(900)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    full = pd.DataFrame(data, columns=list("abc"), dtype=float)
    ranks, found = full.rank(), []
    for limit in (pf.FEW_VALUES, 0):
        monkeypatch.setattr(pf, "FEW_VALUES", limit)
        found.append({(r["col_a"], r["col_b"]): r["corr"] for r in pf.spearman_matrix(df).collect()})
    assert found[0] == found[1]
    for (a, b), corr in found[0].items():
        both = ranks[[a, b]].dropna()
        assert abs(corr - np.corrcoef(both[a], both[b])[0, 1]) < 1e-5


def test_distinct_decimals_and_alert_scan(spark):
    """groups are told apart by what differs; skewness and correlations come from one scan."""
    df = spark.sql("SELECT CAST(id AS BIGINT) + 9007199254740992 AS big, CAST(id AS BIGINT) AS small, "
                   "CAST(1 AS DECIMAL(38, 20)) + CAST(id AS DECIMAL(38, 20)) / 100000000000000000000 AS d FROM range(40)")
    got = {r["column"]: r["n_distinct"] for r in pf.numeric_summary(df).collect()}
    assert got["big"] == got["small"] == 40 and got["d"] == df.select("d").distinct().count()
    plain = df.selectExpr("CAST(small AS DOUBLE) AS x", "CAST(small * 2 AS DOUBLE) AS y", "CAST(small % 2 AS DOUBLE) AS z")
    assert {(r["column"], r["alert"]) for r in pf.alerts(plain).collect()} == {
        ("x", "HIGH_CARDINALITY"), ("y", "HIGH_CARDINALITY"), ("z", "ZEROS"), ("x ~ y", "HIGH_CORRELATION")}
