import hashlib
from collections import defaultdict

import numpy as np

from helpers import DOC_SCHEMA, empty_documents, odd_documents, rows_of
from litsieve.llm import linededup, queries

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_answers(docs):
    """docs: (doc_id, text) -> (doc_id, lines, dropped, kept text); a document is all rows of an id."""
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders[line.strip(SPACE).translate(LOWER)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines for k in [x.strip(SPACE).translate(LOWER)]
                if len(k) < 20 or len(holders[k]) < 3 or i == max(h for h in holders[k] if h is not None)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def some_documents(spark, n=400):
    shared = ["A line that many documents share, word for word", "éèü" * 7 + " café", "short shared line", "x" * 19, "y" * 20, "日本" * 10, "日本" * 9 + "x"]
    rows = []
    for i in range(n):
        lines = [f"own line of document number {i} with words"]
        lines += [s for k, s in enumerate(shared) if i % (k + 2) == 0]
        if i % 3 == 0:                                       # a third of all documents hold it, twice and in other spellings
            lines += ["  THE one line of a THIRD of all documents\t", "the one line of a third of all documents\r", ""]
        rows.append((i, "\n".join(lines)))
    rows += [(5, "again five\nThe one line of a third of all documents"), (5, "again five\nThe one line of a third of all documents"),
             (None, "y" * 20), (None, "only rows without an id hold this line"), (None, "only rows without an id hold this line"), (None, "only rows without an id hold this line"),
             (7, "one doc_id holds this line, in three rows"), (7, "one doc_id holds this line, in three rows"), (7, "one doc_id holds this line, in three rows"),
             (901, "two documents hold this line, no more"), (902, "two documents hold this line, no more"), (903, None), (904, ""), (905, "\n\n"),
             (906, "\n".join(["y" * 20] * 3)), (907, "﻿non-breaking stays  ")]
    return rows, spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC_SCHEMA)


def order(rows):
    return sorted(rows, key=str)


def test_equals_plain_answers(spark):
    rows, docs = some_documents(spark)
    got = [tuple(r) for r in linededup.dedup_lines(docs.repartition(7)).collect()]
    assert order(got) == order(plain_answers(rows))
    assert sum(r[2] > 0 for r in got) > 100


def test_many_shards_and_chunks(spark, monkeypatch):
    rows, docs = some_documents(spark, 200)
    monkeypatch.setattr(linededup, "CHUNK_LINES", 9)
    got = [tuple(r) for r in linededup.dedup_lines(docs, shard_keys=5).collect()]
    assert order(got) == order(plain_answers(rows))


def test_a_chunk_asks_once_for_a_line(spark):
    _, docs = some_documents(spark, 200)
    plain = docs.selectExpr("doc_id", "xxhash64(text) AS text_hash", "CAST(coalesce(text, '') AS BINARY) AS text").coalesce(1)
    lines = linededup.line_table(plain)
    assert lines.where("first").count() == lines.select("chunk", "h1", "h2").distinct().count() < lines.count()


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        h1, h2 = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(2))
        if n > 10:
            h1[:5] = h1[0]                                   # equal first halves still tell apart
        levels = linededup.build_hash(h1, h2)
        index = linededup.find(levels, linededup.rank_levels(levels), h1, h2)
        assert sorted(index.tolist()) == list(range(n))
        assert sum(len(b) for b in levels) <= 4 * n + 64 * len(levels)


def test_arrays_know_their_lines_and_no_others():
    rng = np.random.default_rng(2)
    h1, h2, last = (rng.integers(0, 1 << 62, 3000, dtype=np.uint64) for _ in range(3))
    counts = rng.integers(1, 70_000, 3000)
    shard = linededup.Shard(*linededup.Shard.pack(h1, h2, counts, last.astype(np.int64)).values())
    n, who = shard.probe(h1, h2)
    assert (n == counts).all() and (who == last.astype(np.int64)).all()
    n, _ = shard.probe(h1 + np.uint64(1), h2 + np.uint64(1))
    assert not n.any()


def test_key_length_counts_code_points():
    assert linededup.long_enough("日".encode() * 20, 20) and not linededup.long_enough("日".encode() * 19, 20)
    assert linededup.line_keys("ÉA B\x0c\n Z ".encode()) == ["Éa b".encode(), " z".encode()]


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = [tuple(r) for r in linededup.dedup_lines(docs).collect()]
    assert order(got) == order(plain_answers([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_empty_table(spark):
    assert linededup.dedup_lines(empty_documents(spark)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_answers(rows)]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows_of(queries.op12_line_dedup(spark, sf))]
    assert order(got) == order(want)
