import itertools
import random
import zlib

from helpers import empty_documents, odd_documents, rows_of
from litsieve.llm import sharding
from litsieve.session import read_table


def fits(sizes, shards, capacity):
    used, room = 1, capacity
    for s in sizes:
        if s > capacity:
            return False
        if s > room:
            used, room = used + 1, capacity
        room -= s
    return used <= shards


def all_loads(sizes, shards):
    for inner in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        cuts = [0, *inner, len(sizes)]
        yield [sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])]


def test_smallest_capacity_and_largest_floor():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 40))]
        shards = rng.randint(1, 8)
        capacity, ends = sharding.minimax_cuts(sizes, shards)
        assert fits(sizes, shards, capacity) and not fits(sizes, shards, capacity - 1)
        cuts = [0, *ends]
        assert ends[-1] == len(sizes) and all(sum(sizes[a:b]) <= capacity for a, b in zip(cuts, cuts[1:]))
        least = max((min(loads) for loads in all_loads(sizes[:8], min(shards, 4)) if max(loads) <= sharding.minimax_cuts(sizes[:8], min(shards, 4))[0]))
        cuts = [0, *sharding.minimax_cuts(sizes[:8], min(shards, 4))[1]]
        assert min(sum(sizes[:8][a:b]) for a, b in zip(cuts, cuts[1:])) == least
    assert sharding.minimax_cuts([], 3) == (0, [0, 0, 0])


def check(docs, rows):
    assert len(rows) == len(docs)
    have = sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str)
    data = [(d["doc_id"], (d["text"] or "").encode()) for d in docs]
    assert have == sorted(((i, len(t) + 8, zlib.crc32(t)) for i, t in data), key=str)
    by = {}
    for r in rows:
        assert 0 <= r["shard"] < 24 and r["law"] == "bytes" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    same = {}
    for r in rows:
        same.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in same.values())
    return {k: sum(r["size"] for r in v) for k, v in by.items()}


def test_table(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    load = check(rows_of(docs), rows_of(sharding.shard_documents(docs)))
    mean = sum(load.values()) / 24
    assert len(load) == 24 and max(load.values()) < 1.35 * mean and min(load.values()) > 0.9 * mean


def test_odd_documents(spark):
    docs = odd_documents(spark)
    check(rows_of(docs), rows_of(sharding.shard_documents(docs)))
    assert sharding.shard_documents(empty_documents(spark)).count() == 0
