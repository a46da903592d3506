"""A sample of the driver's Spark-vs-DuckDB comparison (the full run: tools/oracle_check.py)."""

import duckdb

import __spark_entry__ as entry
from support import SF01
from tools.oracle_check import TABLES, canon

SAMPLE = ["exact_first", "near_dedup", "fuzzy_dedup_90", "phrase_labels", "substring_last_wins", "profile_quantiles",
          "corr_spearman", "tfidf", "seed_assignment", "pubmed_roundtrip"]


def test_sample_matches_oracle(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    qs, orc = entry.queries(), entry.oracle_sql()
    for name in SAMPLE:
        sdf = qs[name](spark, SF01)
        srows = [tuple(r) for r in sdf.collect()]
        cur = con.execute(orc[name])
        drows, dcols = cur.fetchall(), [d[0] for d in cur.description]
        assert sorted(sdf.columns) == sorted(dcols), name
        assert canon(srows, sdf.columns) == canon(drows, dcols), name
