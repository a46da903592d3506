import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    got = {r["category"]: r["n_papers"] for r in df.collect()}
    assert got and all(v > 0 for v in got.values())


def test_every_oracle_has_a_query():
    qs, orc = entry.queries(), entry.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 60


def test_sample_queries_run_on_smallest_data(spark):
    qs = entry.queries()
    for name in ("papers_view", "exact_first", "phrase_labels", "substring_last_wins", "profile_numeric"):
        assert qs[name](spark, "/root/testdata/sf0.001").count() >= 0
