import numpy as np
from helpers import empty_documents, odd_documents, rows_of
from litsieve.llm import mixing
from litsieve.session import read_table


def plain_targets(size):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(3 * size[s] for s in full)
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]} if free else set()
        if not over:
            return {s: 3 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in names}
        full |= over


def test_quotas_split_exactly():
    rng = np.random.default_rng(1)
    quotas = np.array([1000, 3, 0, 517, 42])
    for shards in (1, 2, 5, 16):
        parts = mixing.split_quotas(quotas, shards, rng)
        assert (parts.sum(axis=1) == quotas).all() and parts.shape == (5, shards)
        assert np.ptp(parts.sum(axis=0)) <= np.log2(shards) + 1


def check(docs, rows, near):
    words = lambda t: len((t or "").encode().split())
    size = {}
    for d in docs:
        size[d["source"]] = size.get(d["source"], 0) + words(d["text"])
    target, taken, shards = plain_targets(size), dict.fromkeys(size, 0), {}
    assert len(rows) == len(docs)
    for r in rows:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, r["target"])
        assert r["copies"] <= 3 and len(r["shards"]) == r["copies"]
        taken[r["source"]] += r["size"] * r["copies"]
        for s in r["shards"]:
            shards[s] = shards.get(s, 0) + 1
    for s in size:
        assert abs(taken[s] - target[s]) <= near * max(1, target[s]), (s, taken[s], target[s])
    return shards


def test_mixture_of_a_table(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = rows_of(mixing.mixture(docs, shards=8))
    shards = check(rows_of(docs), rows, 0.05)
    assert max(shards.values()) - min(shards.values()) <= 4
    again = rows_of(mixing.mixture(docs.repartition(3), shards=8))
    assert sorted(map(str, rows)) == sorted(map(str, again))
    drawn = rows_of(mixing.mix(docs, shards=8))
    assert len(drawn) == sum(r["copies"] for r in rows)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = rows_of(mixing.mixture(docs))
    check(rows_of(docs), rows, 1.0)
    drawn = mixing.mix(docs)
    assert drawn.columns == [c for c in docs.columns if c != "shard"] + ["shard"]
    assert drawn.count() == sum(r["copies"] for r in rows)
    assert mixing.mixture(empty_documents(spark)).count() == 0 and mixing.mix(empty_documents(spark)).count() == 0


def test_a_very_long_document_shuts_none_out(spark):
    """Wherever the long document stands in the order, the short ones behind it fill the target."""
    rows = [(i, "w " * 100, "a") for i in range(600)] + [(1_000 + i, "w " * (20_000 if i == 0 else 20), "b") for i in range(2_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2, 3, 4):
        got = rows_of(mixing.mixture(docs, shards=4, seed=seed))
        check([{"source": s, "text": t} for _, t, s in rows], got, 0.002)
