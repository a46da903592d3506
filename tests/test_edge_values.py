"""Values at the edges: NaN and infinities, microseconds, zero vectors, long category names, large lexicons."""
import datetime as dt
import math

from litsieve.functions.lexicon import Lexicon
from litsieve.operators import categorize, profile, vectors
from litsieve.sinks.files import write_by_category
from litsieve.sources.landed import _strip_tags
from pyspark.sql import functions as F


def test_quantiles_with_nan_and_infinite_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(x,) for x in [1.0, 3.0] + [nan] * 8 + [None]], "x double")
    assert profile.exact_quantiles(df, "x", [0.0, 0.5, 1.0]) == {0.0: 1.0, 0.5: 2.0, 1.0: 3.0}
    df = spark.createDataFrame([(x,) for x in [-inf, 1.0, 2.0, 5e-324, inf]], "x double")
    assert profile.order_statistics(df, "x", [0, 1, 2, 3, 4]) == {0: -inf, 1: 5e-324, 2: 1.0, 3: 2.0, 4: inf}
    assert math.isclose(profile.exact_quantiles(spark.createDataFrame([(nan,)], "x double").unionByName(
        spark.createDataFrame([(4.0,)], "x double")), "x", [0.5])[0.5], 4.0)


def test_rows_a_microsecond_apart_are_distinct(spark):
    t = dt.datetime(2024, 1, 1, 0, 0, 0, 1)
    df = spark.createDataFrame([(t, 1), (t + dt.timedelta(microseconds=1), 1), (t, 1)], "t timestamp, n int")
    assert profile.overview(df).first()["n_duplicate_rows"] == 1


def test_zero_vectors_have_no_cluster(spark):
    rows = [(i, [1.0, i / 10]) for i in range(6)] + [(6 + i, [-1.0, i / 10]) for i in range(6)] + [(20, [0.0, 0.0]), (21, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in vectors.kmeans_cosine(df, "v", 2).collect()}
    assert len(got) == 14 and got[20] == got[21] == "Uncategorized"
    assert len({got[i] for i in range(12)}) == 2 and got[0] != got[6]


def test_categories_with_one_long_prefix_are_kept_apart(spark, tmp_path):
    a, b = "x" * 40 + "a", "x" * 40 + "b"
    df = spark.createDataFrame([(1, a), (2, b), (3, b), (4, None), (5, "short")], "id long, primary_category string")
    path = str(tmp_path / "by")
    counts = {r["primary_category"]: r["n_papers"] for r in write_by_category(df, path).collect()}
    assert counts == {a: 1, b: 2, None: 1, "short": 1}
    back = spark.read.parquet(path)
    assert back.count() == 5 and back.select("category_key").distinct().count() == 4
    assert back.groupBy("category_key").agg(F.count_distinct("primary_category").alias("n")).where("n > 1").count() == 0


def test_phrase_labels_take_any_number_of_terms(spark):
    df = spark.createDataFrame([("term7 here and term600 too",), ("none",)], "Title string")
    few = Lexicon((("A", ("term7",)), ("B", ("term600",))))
    terms = tuple(f"term{i}" for i in range(700))
    many = type(few)((("A", terms[:300]), ("B", terms[300:])))
    for lexicon in (few, many):
        got = [r["primary_category"] for r in categorize.phrase_labels(df, ["Title"], lexicon).collect()]
        assert got == ["A, B", "Uncategorized"]


def test_only_inline_markup_leaves_titles(spark):
    titles = ["Dose <5 mg and >10 mg in adults", "H<sub>2</sub>O and <i>E. coli</i>", "a <b class='x'>b</b> <c> d"]
    df = spark.createDataFrame([(t,) for t in titles], "t string").select(_strip_tags(F.col("t")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["Dose <5 mg and >10 mg in adults", "H2O and E. coli", "a b <c> d"]
