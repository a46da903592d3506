"""Similarity joins by cells against all pairs, with blocks of a few rows."""
import itertools
import random

from pyspark.sql import functions as F

from litsieve.operators import cells, fuzzy, setsim
from support import rows
from test_edit_join import _keys, _pairs


def test_edit_join_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL_WEIGHT", 20_000)
    keys = _keys(random.Random(5), 160)
    items = spark.createDataFrame(list(keys.items()), "id long, key string")
    assert rows(fuzzy.edit_pairs(items, 85), "id_a", "id_b") == _pairs(keys, 85)


def test_word_sets_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL_WEIGHT", 20_000)
    rnd = random.Random(6)
    sets = {i: [f"w{x}" for x in rnd.sample(range(40), rnd.choice([1, 5, 12, 20]))] for i in range(150)}
    sets |= {200 + i: sets[i][:-1] + [f"v{i}"] for i in range(60)}
    want = [(a, b) for a, b in itertools.combinations(sorted(sets), 2)
            if len({*sets[a]} & {*sets[b]}) >= 0.7 * len({*sets[a]} | {*sets[b]}) - 1e-9]
    items = spark.createDataFrame(list(sets.items()), "id long, words array<string>")
    assert want and rows(setsim.jaccard_pairs(items, 0.7), "id_a", "id_b") == want


def test_meetings_are_not_shuffled(spark):
    """Hundreds of keys that share most segments and yet are no pairs: what the join shuffles is a row a key and cell."""
    rnd = random.Random(7)
    parts = ["".join(rnd.choice("abcdefgh ") for _ in range(40)) for _ in range(12)]
    keys = [(i, "".join(rnd.choice(parts) for _ in range(10))) for i in range(300)]
    rows_sent = cells.cells(fuzzy.edit_keys(spark.createDataFrame(keys, "id long, key string")).withColumn("band", setsim.size_band(F.col("L"), 0.9)), "band", "L")
    assert rows_sent.count() <= 3 * len(keys)


def test_repeated_ids_give_a_pair_once(spark):
    text = "abcdefgh " * 30
    items = spark.createDataFrame([(1, text), (1, text), (2, text + "x")], "id long, key string")
    assert rows(fuzzy.edit_candidates(fuzzy.edit_keys(items), 90)) == [(1, 2)]


def test_a_key_is_sent_to_two_cells(spark):
    """A band that fits one block: its keys go to its own cell and, as partners of smaller ones, to that of the band below."""
    rnd = random.Random(9)
    keys = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(100, 900)))) for i in range(200)]
    sent = cells.cells(fuzzy.edit_keys(spark.createDataFrame(keys, "id long, key string")).withColumn("band", setsim.size_band(F.col("L"), 0.9)), "band", "L")
    assert sent.count() <= 2 * len(keys)


def test_repeated_segments_count_once_a_key(spark):
    """Keys of one repeated stretch beside others that hold it once, over groups and chunks of a few keys."""
    rnd = random.Random(10)
    keys = {i: "xyz uvw " * rnd.randint(4, 60) for i in range(25)}
    keys |= {100 + i: "xyz uvw " + "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(20, 400))) for i in range(40)}
    items = spark.createDataFrame(list(keys.items()), "id long, key string")
    assert rows(fuzzy.edit_pairs(items, 90), "id_a", "id_b") == _pairs(keys, 90)


def test_prefixes_that_share_too_little_are_no_candidates(spark):
    """Sets that share one rare word and nothing else of their prefixes: neither order of the prefixes allows the overlap."""
    sets = [(i, ["shared"] + [f"w{i}x{j}" for j in range(99)]) for i in range(12)] + [(50, ["shared"] + [f"w0x{j}" for j in range(99)])]
    items = spark.createDataFrame(sets, "id long, words array<string>")
    assert rows(setsim.prefix_candidates(setsim.prefix_sets(items, 0.85), 0.85)) == [(0, 50)]


def test_verification_of_repeated_ids_and_cut_groups(spark, monkeypatch):
    monkeypatch.setattr(setsim, "PAIRS_A_GROUP", 2)
    sets = {i: ["a", "b", "c", "d", "e", "f", f"v{i}"] for i in range(6)}
    items = spark.createDataFrame([*sets.items(), (3, sets[3]), (9, ["x"])], "id long, words array<string>")
    cand = spark.createDataFrame([(a, b) for a, b in itertools.combinations(range(6), 2)] + [(0, 9)], "id_a long, id_b long")
    want = sorted((a, b, 0.75) for a, b in itertools.combinations(range(6), 2) for _ in range(2 if 3 in (a, b) else 1))
    assert rows(setsim.verify_jaccard(cand, items, 0.7), "id_a", "id_b", "jaccard") == want
