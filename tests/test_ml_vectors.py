import itertools
import math
import random
import tempfile

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from support import SF001, rows
from litsieve.operators import classify as cl
from litsieve.operators import vectors as vc
from litsieve.session import read_table


def test_holdout_is_deterministic_and_sized(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    train, test = cl.holdout_split(df, "doc_id", 20)
    n = test.count()
    assert 300 < n < 500 and train.count() + n == 2000
    assert rows(cl.holdout_split(df.repartition(7), "doc_id", 20)[1]) == rows(test)


def test_tfidf_matches_python(spark):
    docs = [(1, "The cat sat; the cat!"), (2, "a dog, the dog"), (3, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): r["weight"] for r in cl.tfidf_long(df, "doc_id", "text").collect()}
    import re
    toks = {d: re.findall(r"\w{2,}", t.lower()) for d, t in docs}
    n = len(docs)
    dfreq = {}
    for d, ts in toks.items():
        for t in set(ts):
            dfreq[t] = dfreq.get(t, 0) + 1
    for d, ts in toks.items():
        w = {t: ts.count(t) * (math.log((1 + n) / (1 + dfreq[t])) + 1) for t in set(ts)}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            assert abs(got[(d, t)] - v / norm) < 1e-12
    assert (3, "x") not in got


def test_forest_fit_predict_save_load(spark):
    docs = read_table(spark, SF001, "documents").join(read_table(spark, SF001, "labels"), "doc_id")
    train, test = cl.holdout_split(docs, "doc_id")
    model = cl.fit_forest(train, ["text"], "quality", num_trees=50, num_features=4096)
    root = tempfile.mkdtemp(prefix="litsieve-model-")
    cl.save_model(model, root, "quality")
    again = cl.load_model(root, "quality")
    a = rows(cl.predict(model, test.select("doc_id", "text"), ["text"]), "doc_id", "prediction")
    b = rows(cl.predict(again, test.select("doc_id", "text"), ["text"]), "doc_id", "prediction")
    assert a == b and {p for _, p in a} <= {"0", "1"}
    try:
        cl.load_model(root, "missing")
        raise AssertionError("expected a clear error")
    except FileNotFoundError:
        pass


def test_zero_shot_and_metrics(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et la souris", "fr"), (3, "", "en"),
                                (4, "zzz", "de")], "paper_id long, t string, lang string")
    pred = cl.zero_shot_overlap(df, ["t"], {"en": "the of and", "fr": "le la et"})
    got = dict(rows(pred, "paper_id", "prediction"))
    assert got == {1: "en", 2: "fr", 3: "Unknown", 4: "Unknown"}
    per, acc = cl.evaluate(pred, "lang", "prediction")
    assert acc.first()["accuracy"] == 0.5
    en = [r for r in per.collect() if r["label"] == "en"][0]
    assert (en["support"], en["precision"], en["recall"]) == (2, 1.0, 0.5)


def _naive_average_linkage(X, k):
    X = X / np.linalg.norm(X, axis=1, keepdims=True)
    clusters = [[i] for i in range(len(X))]
    D = 1 - X @ X.T
    while len(clusters) > k:
        best = None
        for a, b in itertools.combinations(range(len(clusters)), 2):
            d = np.mean([D[i, j] for i in clusters[a] for j in clusters[b]])
            if best is None or d < best[0] - 1e-12:
                best = (d, a, b)
        _, a, b = best
        clusters[a] = clusters[a] + clusters[b]
        del clusters[b]
    return sorted(sorted(c) for c in clusters)


def test_average_linkage_matches_naive(spark):
    rnd = np.random.default_rng(4)
    centers = rnd.normal(size=(4, 8))
    X = np.vstack([c + 0.3 * rnd.normal(size=(10, 8)) for c in centers])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(X)], "id long, v array<float>")
    out = vc.average_linkage(df, "v", "id", k=4).collect()
    got = {}
    for r in out:
        got.setdefault(r["cluster"], []).append(r["id"])
    assert sorted(sorted(v) for v in got.values()) == _naive_average_linkage(X.astype(np.float32).astype(float), 4)
    assert min(got["Cluster 1"]) == 0


def _groups(out):
    got = {}
    for r in out.collect():
        got.setdefault(r["cluster"], []).append(r["id"])
    return got


def test_average_linkage_rounds_equal_pair_by_pair(spark):
    rnd = np.random.default_rng(11)
    X = rnd.normal(size=(60, 6)).astype(np.float32)
    X[40:50] = X[3] * 2                                   # copies of one direction
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(X)], "id long, v array<float>")
    for k, tail, block in ((5, 1, 16), (12, 12, 7)):
        got = _groups(vc.average_linkage(df, "v", "id", k=k, tail=tail, rows_a_task=block))
        assert sorted(sorted(v) for v in got.values()) == _naive_average_linkage(X.astype(float), k), (k, tail)
        assert [min(got[f"Cluster {i + 1}"]) for i in range(k)] == sorted(min(v) for v in got.values())


def test_average_linkage_chain_takes_few_rounds(spark):
    """a cluster that takes in one row after the other does so within a task, not once a round of jobs."""
    n, p = 48, 1 - 0.01 * np.arange(48)
    gram = np.minimum.outer(p, p)                         # the similarity of two rows is set by the later one
    np.fill_diagonal(gram, 1.0)
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(np.linalg.cholesky(gram))],
                               "c long, v array<double>, n long")
    got = vc.average_linkage_merges(df, tail=16).orderBy("round", "turn").collect()
    assert [(r["loser"], r["winner"]) for r in got] == [(i, 0) for i in range(1, n)]
    assert np.allclose([r["h"] for r in got], p[1:], atol=1e-11) and got[-1]["round"] <= 4


def test_average_linkage_odd_vectors(spark):
    data = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, float("nan")]), (5, [1.0, None]), (6, [2.0, 0.0]), (7, [0.0, 1.0]),
            (8, [float("inf"), 1.0]), (9, [])]
    df = spark.createDataFrame(data, "id long, v array<double>").withColumn("c", F.lit("x")).withColumn("h", F.lit(1))
    got = _groups(vc.average_linkage(df, "v", "id", k=2))
    assert {k: sorted(v) for k, v in got.items()} == {"Cluster 1": [1, 6], "Cluster 2": [7], "Uncategorized": [2, 3, 4, 5, 8, 9]}
    assert {k: sorted(v) for k, v in _groups(vc.average_linkage(df, "v", "id", k=5)).items() if k != "Uncategorized"} == {
        "Cluster 1": [1], "Cluster 2": [6], "Cluster 3": [7]}
    assert vc.average_linkage(df.filter("id < 0"), "v", "id", k=2).count() == 0
    ties = spark.createDataFrame([(i, [float(i % 4 == j) for j in range(4)]) for i in range(12)], "id long, v array<double>")
    assert {k: sorted(v) for k, v in _groups(vc.average_linkage(ties, "v", "id", k=3, tail=1)).items()} == {
        "Cluster 1": [0, 1, 4, 5, 8, 9], "Cluster 2": [2, 6, 10], "Cluster 3": [3, 7, 11]}


def test_seed_assignment_threshold(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, -1.0])], "id long, v array<float>")
    out = dict(rows(vc.assign_to_seeds(df, "v", {"x": [1.0, 0.0], "y": [0.0, 1.0]}, min_similarity=0.1), "id", "cluster"))
    assert out == {1: "x", 2: "y", 3: "Uncategorized"}


def test_embed_and_kmeans(spark):
    df = spark.createDataFrame([(i, random.Random(i).choice(["red apple fruit", "blue sky cloud"])) for i in range(40)],
                               "id long, t string")
    emb = vc.embed(df, "t", dim=32)
    assert len(emb.first()["embedding"]) == 32
    km = vc.kmeans_cosine(emb, "embedding", k=2)
    pur = vc.purity(km, "cluster", "t").first()["purity"]
    assert pur == 1.0


def test_nearest_seed_equals_brute_force(spark):
    rnd = np.random.default_rng(6)
    rows, seeds = rnd.normal(size=(700, 8)), rnd.normal(size=(300, 8))
    seeds[17] = seeds[203] * 2  # a tie by direction
    data = [(i, v.tolist()) for i, v in enumerate(rows)]
    odd = [(700, None), (701, [0.0] * 8), (702, [1.0] * 3), (703, [float("nan")] * 8), (704, []), (705, seeds[203].tolist())]
    df = spark.createDataFrame(data + odd, "id long, vec array<double>").withColumn("name", F.lit("mine"))
    table = spark.createDataFrame([(f"s{i:03}", v.tolist()) for i, v in enumerate(seeds)] + [("null", None), ("zero", [0.0] * 8)],
                                  "name string, v array<double>")
    for task, block in ((100, 40), (20_000, 4_096)):
        got = {r["id"]: r for r in vc.nearest_seed(df, "vec", "id", table, rows_a_task=task, seed_rows=block).collect()}
        assert len(got) == 706 and got[0]["name"] == "mine"
        sim = (rows / np.linalg.norm(rows, axis=1)[:, None]) @ (seeds / np.linalg.norm(seeds, axis=1)[:, None]).T
        for i in range(700):
            assert got[i]["cluster"] == f"s{np.round(sim[i], 12).argmax():03}" and abs(got[i]["similarity"] - sim[i].max()) < 1e-12
        assert all((got[i]["cluster"], got[i]["similarity"]) == ("Uncategorized", None) for i in range(700, 705))
        assert got[705]["cluster"] == "s017"  # the first name of the tie
    low = vc.nearest_seed(df, "vec", "id", table, min_similarity=0.9).filter("cluster = 'Uncategorized' AND similarity < 0.9")
    assert low.count() == int((sim.max(axis=1) < 0.9).sum())
    assert vc.nearest_seed(df, "vec", "id", table.limit(0)).filter("similarity IS NULL").count() == 706
    assert vc.nearest_seed(df.limit(0), "vec", "id", table).count() == 0


def test_ten_thousand_seeds(spark):
    seeds = spark.range(10_000).select(F.format_string("s%05d", "id").alias("name"), F.array(F.cos(F.col("id") / 2000.0), F.sin(F.col("id") / 2000.0)).alias("v"))
    df = seeds.select(F.substring("name", 2, 5).cast("long").alias("id"), F.col("v").alias("vec"))
    assert vc.nearest_seed(df, "vec", "id", seeds).filter(F.format_string("s%05d", "id") == F.col("cluster")).count() == 10_000


def test_encoder_is_built_by_the_worker(spark):
    from litsieve.plans.catalog import letter_counts
    df = spark.createDataFrame([(1, "Abba"), (2, ""), (3, None)], "id int, text string")
    got = {r["id"]: r["e"] for r in vc.embed(df, "text", "e", make_encoder=letter_counts, batch_size=2).collect()}
    assert got[1] == [2.0, 2.0] + [0.0] * 24 and got[2] == got[3] == [0.0] * 26


def test_saved_forest_predicts_as_before(spark, tmp_path):
    df = spark.createDataFrame([(i, "red apple fruit" if i % 2 else "blue whale sea", "fruit" if i % 2 else "animal")
                                for i in range(60)], "id int, text string, label string")
    model = cl.fit_forest(df, ["text"], "label", num_trees=50, num_features=256, max_depth=4)
    cl.save_model(model, str(tmp_path), "topic")
    before, after = (cl.predict(m, df, ["text"]).orderBy("id").collect() for m in (model, cl.load_model(str(tmp_path), "topic")))
    assert before == after and {(r["label"], r["prediction"]) for r in after} == {("fruit", "fruit"), ("animal", "animal")}


def test_evaluation_counts_predictions_once(spark):
    """the figures come from one confusion table; of a text only the candidates' words are kept."""
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "b"), ("b", "b")], "label string, pred string")
    per, acc = cl.evaluate(pred, "label", "pred")
    assert "LocalRelation" not in (plan := per._jdf.queryExecution().optimizedPlan().toString()) and "LogicalRDD" in plan
    assert acc.first()["accuracy"] == 0.5
    seen = cl.zero_shot_overlap(spark.createDataFrame([("the the cat",), ("und der",), ("xx",), (None,)], "t string"), ["t"], {"en": "the of", "none": "", "de": "der und"})
    assert [r["prediction"] for r in seen.collect()] == ["en", "de", "Unknown", "Unknown"]


def test_forest_tasks_are_cut_by_rows(spark, monkeypatch):
    """what a training task holds is bounded by rows times columns, not by the size of texts."""
    monkeypatch.setattr(cl, "TRAIN_CELLS", 64 * 25)
    df = spark.createDataFrame([(f"w{i % 3} x{i % 5}", str(i % 3)) for i in range(100)], "text string, label string").coalesce(1)
    sizes = cl.by_rows(df, 64).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) <= 30
    assert cl.by_rows(df.limit(20), 64).select(F.spark_partition_id()).distinct().count() == 1


def test_forest_keeps_rows_nodes_between_passes(spark):
    """rows are not led through the trees again in every pass; the forest is the same."""
    df = spark.createDataFrame([(f"w{i % 7} x{i % 5} y{i % 3}", str(i % 4)) for i in range(80)], "text string, label string").coalesce(1)
    model = cl.fit_forest(df, ["text"], "label", num_trees=50, num_features=64, max_depth=6)
    forest = model.stages[4]
    assert forest.getOrDefault("cacheNodeIds") is True
    data = StringIndexer(inputCol="label", outputCol="__label").fit(df).transform(df.withColumn("ml_text", F.col("text")))
    for stage in model.stages[:4]:
        data = stage.transform(data)
    plain = RandomForestClassifier(featuresCol="features", labelCol="__label", numTrees=50, seed=cl.RANDOM_SEED, maxDepth=6).fit(data)
    assert plain.toDebugString.split("\n")[1:] == forest.toDebugString.split("\n")[1:]


def test_tfidf_shuffles_texts_not_terms(spark):
    import math
    from collections import Counter
    data = [(1, "aa bb aa"), (1, "bb cc"), (2, "cc dd"), (None, "aa"), (None, "ee"), (3, ""), (4, None), (5, "dd, cc dd")]
    out = cl.tfidf_long(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", "text")
    got = {(r["doc_id"], r["term"]): r["weight"] for r in out.collect()}
    counts = {}
    for i, text in data:
        counts.setdefault(i, Counter()).update((text or "").replace(",", "").split())
    df = Counter(t for c in counts.values() for t in c)
    want = {}
    for i, c in counts.items():
        w = {t: n * (math.log((1 + len(counts)) / (1 + df[t])) + 1) for t, n in c.items()}
        want |= {(i, t): x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items() if i is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning(term" not in plan and plan.count("hashpartitioning(id") == 1, plan
