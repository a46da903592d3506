import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from helpers import rows_of
from litsieve.llm import convtrie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def rank(row):
    """The order of turns: by turn, nulls first, ties by the digest."""
    role, text = (row[2] or "").encode(), (row[3] or "").encode()
    return row[1] is not None, row[1] or 0, hashlib.sha256(b"%d:" % len(role) + role + text).hexdigest()


def plain_trie(rows):
    turns = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=rank):
        turns[row[0]].append((row[2] or "", row[3] or ""))
    rebuilt = {}
    for c in turns:
        h, leader = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(leader, [])[:h] + turns[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        own = (len(m) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += not children[node]
    return [{"conv_id": min(m), "depth": len(node), "parent_conv_id": min(members[node[:-1]]) if node else None, "n_convs": len(m),
             "n_children": children[node], "n_leaves": leaves[node], "saved_tokens": saved[node],
             "ends_sha256": hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()} for node, m in members.items()]


def same(df, rows):
    key = lambda r: (r["depth"], r["conv_id"])
    assert sorted(rows_of(df), key=key) == sorted(plain_trie(rows), key=key)


def some_turns(n=160, seed=5):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 3, 4, 8, 12])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), f"hello {rng.randrange(3)}" if rng.random() < 0.7 else f"own é {c} {t}"))
    return rows


def test_equals_plain_trie(spark):
    rows = some_turns()
    same(convtrie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5)), rows)


def test_small_blocks_and_pieces(spark, monkeypatch):
    rows = some_turns(60, 6)
    monkeypatch.setattr(convtrie, "ENDS_PER_PIECE", 2)
    same(convtrie.conversation_trie(spark.createDataFrame(rows, SCHEMA), block_nodes=3), rows)


def test_one_conversation_in_a_third_and_one_long(spark):
    rows = [(c, t, "user", f"the same {t}") for c in range(0, 300, 3) for t in range(4)]
    rows += [(c, t, "user", f"other {c} {t}") for c in range(1, 300, 3) for t in range(2)]
    rows += [(1000, t, "user", f"long {t}") for t in range(400)] + [(1003, t, "user", f"long {t}") for t in range(400)]
    same(convtrie.conversation_trie(spark.createDataFrame(rows, SCHEMA)), rows)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, None, "a", "x"), (0, 1, "a", "x"), (0, 1, "a", "x"), (0, 1, "b", ""), (None, 1, "a", "x"), (None, None, None, None),
            (-3, 0, "u", "t"), (-5, 0, "u", "t"), (-5, 1, "u", "t2"), (-5, 2, "u", "t3"), (7, 0, "u", "L" * 50_000), (11, 0, "u", "short"), (14, 0, "u", "short"),
            (2, 0, "ab", "c"), (3, 0, "a", "bc"), (2**62, 0, "u", "big id")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("d"), "name": F.lit("n"), "no": F.lit("1"), "n_convs": F.lit(3.5), "place": F.lit("x")})
    same(convtrie.conversation_trie(df), rows)
    assert any(r["depth"] == 0 and r["ends_sha256"] != hashlib.sha256(b"").hexdigest() for r in plain_trie(rows))  # a turnless one


def test_empty_table(spark):
    assert convtrie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert convtrie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


def test_list_ranks_of_any_order(spark):
    rng = random.Random(9)
    order = list(range(200))
    rng.shuffle(order)
    arcs = [(a, b) for a, b in zip(order, order[1:] + [None])]
    for block in (1, 7, 1000):
        got = {r["arc"]: r["position"] for r in convtrie.list_ranks(spark.createDataFrame(arcs, "arc long, next long"), block).collect()}
        assert [got[a] for a in order] == list(range(200))


def test_prefix_sums(spark):
    rows = spark.createDataFrame([(i, i * i, 1) for i in range(50)], "at long, v long, w long").repartition(3)
    got = {r["at"]: (r["v"], r["w"]) for r in convtrie.prefix_sums(rows, "at", ["v", "w"], 8).collect()}
    assert got == {i: (sum(j * j for j in range(i + 1)), i + 1) for i in range(50)}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op11_conversation_trie(spark, sf), rows)
