"""The segment join against all pairs, and its distance against the textbook table."""
import itertools
import random

import pytest

from litsieve.functions.edits import bounded_distance
from litsieve.operators import dedup_near as dn
from litsieve.operators import fuzzy as fz
from support import rows


def _table(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        j, op = rnd.randrange(len(s) + 1), rnd.random()
        if op < 0.3 or j == len(s):
            s.insert(j, rnd.choice("abcdé "))
        elif op < 0.6:
            del s[j]
        else:
            s[j] = rnd.choice("abx日")
    return "".join(s)


def _keys(rnd, n=110):
    keys = {i: "".join(rnd.choice("abcde ") for _ in range(rnd.choice([1, 3, 8, 20, 60, 150, 400]))) for i in range(n // 2)}
    for i in range(n // 2, n):
        base = keys[rnd.randrange(n // 2)]
        keys[i] = _edited(rnd, base, rnd.randint(0, max(1, len(base) // 8))) or "a"
    return keys


def _pairs(keys, t):
    out = []
    for a, b in itertools.combinations(sorted(keys), 2):
        longest = max(len(keys[a]), len(keys[b]))
        if abs(len(keys[a]) - len(keys[b])) <= (100 - t) * longest / 100 and 100 * (1 - _table(keys[a], keys[b]) / longest) >= t - 1e-9:
            out.append((a, b))
    return out


def test_distance_equals_table():
    rnd = random.Random(1)
    for _ in range(1500):
        a = "".join(rnd.choice("abé日 ") for _ in range(rnd.randint(0, 60)))
        b, most = _edited(rnd, a, rnd.randint(0, 12)), rnd.randint(0, 15)
        d = _table(a, b)
        assert bounded_distance(a, b, most) == (d if d <= most else None), (a, b, most)


def test_distance_of_repeating_and_long_texts():
    rnd = random.Random(2)
    a = "ab" * 300 + "x" + "a" * 200
    assert bounded_distance(a, a[3:] + "b", 60) == _table(a, a[3:] + "b")
    many = "".join(chr(0x4E00 + rnd.randrange(5000)) for _ in range(3000))       # more letters than a byte counts
    assert bounded_distance(many, many[:1000] + "x" + many[1001:], 300) == 1
    book = "".join(rnd.choice("etaoin shrdlu") for _ in range(60_000))
    assert bounded_distance(book, _edited(rnd, book, 200), 6_000) <= 200
    assert bounded_distance(book, book[::-1], 6_000) is None


@pytest.mark.parametrize("t", [70, 85, 90, 100])
def test_join_equals_all_pairs(spark, t):
    keys = _keys(random.Random(t))
    items = spark.createDataFrame(list(keys.items()), "id long, key string")
    want = _pairs(keys, t)
    assert want and rows(fz.edit_pairs(items, t), "id_a", "id_b") == want
    assert [r[0] for r in rows(fz.rows_with_neighbours(items, t))] == sorted({i for p in want for i in p})


def test_segments_fit_at_every_length():
    for t in (67, 70, 80, 85, 90, 95, 99, 100):
        q = fz.segment_size(t)
        for n in range(fz._long_from(t), 4000):
            assert n // (int((100 - t) * n / t + 1e-9) + 1) >= q, (t, n)


def test_keep_none_lists_no_group(spark):
    """A dense group of near copies: the sketch settles it, so the join of open keys holds none of its pairs."""
    rnd = random.Random(8)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    keys = {i: _edited(rnd, base, 2) for i in range(200)} | {1000 + i: "".join(rnd.choice("abcdefgh ") for _ in range(300)) for i in range(20)}
    items = spark.createDataFrame(list(keys.items()), "id long, key string")
    assert [r[0] for r in rows(fz.rows_with_neighbours(items, 90))] == list(range(200))


def test_fuzzy_dedup_of_whole_papers(spark):
    long = " ".join(f"word{i}" for i in range(300))
    df = spark.createDataFrame([(1, "t", "d", long), (2, "t", "d", long + " x"), (3, "t", "d", "other body " * 30), (4, None, None, None),
                                (5, "", "", ""), (6, "t", "d", long)], "paper_id long, Title string, DOI string, Abstract string")
    kept = {k: [r[0] for r in rows(dn.fuzzy_dedup(df, dn.FuzzyConfig(keep=k)), "paper_id")] for k in ("first", "last", "none")}
    assert kept == {"first": [1, 3, 4, 5], "last": [3, 4, 5, 6], "none": [3, 4, 5]}


def test_band_of_columns_equals_table(monkeypatch):
    """Only the rows that the allowed edits can touch are computed, in blocks of a few columns."""
    from litsieve.functions import edits
    rnd = random.Random(3)
    for block in (1, 7, 512):
        monkeypatch.setattr(edits, "BLOCK", block)
        for _ in range(300):
            a = "".join(rnd.choice("abé日 ") for _ in range(rnd.randint(1, 60)))
            a, b = sorted((a, _edited(rnd, a, rnd.randint(0, 30)) or "a"), key=len)
            d, least = _table(a, b), len(b) - len(a)
            for most in (least, least + 1, least + rnd.randint(0, 60)):
                assert edits._columns(a, b, most) == (d if d <= most else None), (a, b, most)


def test_groups_of_a_few_keys(spark, monkeypatch):
    monkeypatch.setattr(fz, "GROUP_ROWS", 3)
    monkeypatch.setattr(fz, "COUNTERS", 12)
    keys = _keys(random.Random(4), 60)
    cell = fz._cell_candidates(85)
    import numpy as np
    import pyarrow as pa
    raw = [k.encode() for k in keys.values()]
    table = pa.table({"id": list(keys), "text": pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary()), "bytes": pa.array([len(x) for x in raw], pa.int32()),
                      "L": pa.array([len(k) for k in keys.values()], pa.int32()), "open": [True] * len(keys)})
    whole = np.arange(len(keys))
    ids = np.array(list(keys))
    found = {(min(x, y), max(x, y)) for a, b in cell(table, whole, whole) for x, y in zip(ids[a].tolist(), ids[b].tolist())}
    assert {*_pairs(keys, 85)} <= found
