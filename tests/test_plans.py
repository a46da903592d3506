"""Plan discipline: no Cartesian products, pruned scans, recall of the approximate join."""

import re

import __spark_entry__ as entry
from support import SF01
from litsieve.operators import profile as pf
from litsieve.plans.catalog import NUM_COLS
from litsieve.session import read_table

NO_ALL_PAIRS = ["exact_first", "duplicate_flags", "near_pairs", "near_pairs_lsh", "fuzzy_pairs_ratio", "combined_pairs",
                "phrase_labels", "phrase_labels_join", "substring_last_wins", "seed_assignment", "tfidf",
                "profile_overview", "profile_text", "chi2_cramers_v"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_joins(spark):
    qs = entry.queries()
    for name in NO_ALL_PAIRS:
        plan = _plan(qs[name](spark, SF01))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_scans_read_only_needed_columns(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)  # the whole list of columns
    plan = _plan(pf.value_groups(read_table(spark, SF01, "lineitem"), NUM_COLS, dict.fromkeys(NUM_COLS, 0)))
    assert "Expand" not in plan
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert sorted(c.split(":")[0] for c in read.split(",")) == sorted(NUM_COLS)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_lsh_recall_against_exact_pairs(spark):
    row = entry.queries()["pair_quality"](spark, SF01).first()
    assert row["precision"] == 1.0 and row["recall"] >= 0.99
