import numpy as np
import pytest
from litsieve.llm import topk
from pyspark.sql import functions as F


def brute(rows, queries, k):
    """rows: {id: [ints]}"""
    out = set()
    for q in queries:
        pad = lambda v, n: list(v) + [0] * (n - len(v))
        scored = []
        for i, v in rows.items():
            if i != q:
                n = max(len(v), len(rows[q]))
                scored.append((-sum(a * b for a, b in zip(pad(v, n), pad(rows[q], n))), i))
        for rank, (s, i) in enumerate(sorted(scored)[:k], 1):
            out.add((q, rank, i, -s))
    return out


@pytest.mark.parametrize("share", [0.5, 64, 10**9])
@pytest.mark.parametrize("k", [1, 5, 20])
def test_maxscore_cell_matches_brute_force(k, share, monkeypatch):
    monkeypatch.setattr(topk, "PROBE_SHARE", share)
    monkeypatch.setattr(topk, "RUN_ROWS", 64)
    monkeypatch.setattr(topk, "RUN_QUERIES", 7)
    rng = np.random.default_rng(k)
    docs = rng.integers(-9, 10, (500, 12)) * (rng.random((500, 12)) < 0.5)
    docs[100:260] = docs[3]                                    # many equal vectors: ties to smaller ids
    docs = docs * np.array([5, 4, 3, 2, 1, 1, 1, 1, 1, 1, 1, 0])
    ids = np.arange(500) * 3
    q = np.arange(0, 500, 17)
    got = topk.maxscore(ids, docs, ids[q], docs[q], k)
    have = {}
    for a, i, s in zip(*(x.tolist() for x in got)):
        have.setdefault(a, []).append((-s, i))
    want = brute({int(i): d.tolist() for i, d in zip(ids, docs)}, [int(x) for x in ids[q]], k)
    assert {(a, r, i, -s) for a, v in have.items() for r, (s, i) in enumerate(sorted(v), 1)} == want


def test_top_k_over_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(0)
    rows = {int(i): rng.integers(-40, 40, 8).tolist() for i in range(300)}
    rows[7], rows[8], rows[10**12] = [], [1] * 3, [2**40, -3, 0, 0, 0, 0, 0, 1]   # short and very large components
    df = spark.createDataFrame(list(rows.items()), "vec_id long, vector array<long>")
    df = df.unionByName(df.where("vec_id < 9")).withColumn("rank", F.lit("x"))     # repeated rows, a clashing name
    got = {tuple(r) for r in topk.top_k(df, df.where("vec_id % 20 = 0"), 20).collect()}
    assert got == brute(rows, [i for i in rows if i % 20 == 0], 20)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, [0.5, 0.25]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [0.5, 0.2499]),
                                (None, [1.0, 1.0]), (6, [-0.001, 0.0])], "vec_id long, embedding array<float>")
    v = df.select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id % 20 = 0"), 20).orderBy("rank").collect()]
    assert got == [(0, 1, 5, 32 * 32 + 16 * 15), (0, 2, 6, -32)]
    none = v.where("vec_id < -1")
    assert topk.top_k(none, none).count() == 0
