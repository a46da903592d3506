import random

import numpy as np
import xxhash
from helpers import empty_documents, odd_documents, rows_of
from litsieve.llm import simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    if not grams:
        return 0
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=3):
    """{fp: smallest fp index reachable} by comparing all with all."""
    low = list(range(len(fps)))

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    arr = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius):
            a, b = sorted((top(i), top(int(j))))
            low[b] = a
    return [top(i) for i in range(len(fps))]


def test_fingerprints_match_plain_form():
    texts = [None, "", " \t ", "One", "one TWO", "ÀB c d e", "a b c d " * 50, "x\x0by\x0cz\rw", "the cat sat on the mat"]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def ball(rng, n):
    fps, centres = set(), [rng.getrandbits(64) for _ in range(6)]
    while len(fps) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 7)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
        if rng.random() < 0.2:
            fps.add(rng.getrandbits(64))
    return sorted(fps)


def test_components_equal_all_pairs(spark):
    rng = random.Random(3)
    fps = ball(rng, 700)
    for i in range(1, 40, 3):     # chains of links of exactly three bits
        fps += [fps[i] ^ 7, fps[i] ^ (7 << 21) ^ 7, fps[i] ^ (1 | 1 << 30 | 1 << 63)]
    fps = list(dict.fromkeys(fps))
    want = plain_components(fps)
    rows = spark.createDataFrame([(i, simhash._signed(x)) for i, x in enumerate(fps)], "doc_id long, fp long")
    for bucket in (64, 3, 1):      # 1: nearly everything takes the full-width form
        got = {r["doc_id"]: r["component_id"] for r in rows_of(simhash.component_ids(rows, bucket))}
        assert [got[i] for i in range(len(fps))] == want, bucket


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = rows_of(simhash.simhash_components(docs))
    assert len(got) == docs.count()
    for r, d in zip(sorted(got, key=str), sorted(got, key=str)):
        assert r == d
    by = {r["doc_id"]: r for r in got}
    assert by[3]["fp"] == by[4]["fp"] == by[5]["fp"] == 0
    assert {by[i]["component_id"] for i in (3, 4, 5)} == {3}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1} and by[6]["component_id"] == 6
    nulls = sorted((r["fp"] == 0, r["component_id"]) for r in got if r["doc_id"] is None)
    assert nulls == [(False, None), (True, 3)]
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows_of(kept))
    assert ids == [(False, i) for i in (1, 3, 6, 7, 8, 9, 10, 11)] + [(True, 0)]


def test_empty_table(spark):
    assert simhash.simhash_components(empty_documents(spark)).count() == 0
    assert simhash.deduplicate(empty_documents(spark)).count() == 0
