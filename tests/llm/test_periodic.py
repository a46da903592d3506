import hashlib
import random
import re
import zlib

import numpy as np

from helpers import empty_documents, odd_documents, rows_of
from litsieve.llm import periodic, queries


def plain_runs(words):
    """Every lag compared word by word; of equal spans the smallest period."""
    n, found, numbers = len(words), {}, {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], dtype=np.int64)
    for q in range(1, n // 2 + 1):
        unequal = np.flatnonzero(np.r_[True, w[:-q] != w[q:], True])      # stretches lie between these
        long = np.flatnonzero(np.diff(unequal) - 1 >= max(q, 12 - q))
        for k in long:
            found.setdefault((int(unequal[k]), int(unequal[k + 1]) - 1 + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_answer(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {"doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None, "runs_sha256": sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            "collapsed_sha256": sha(" ".join(w for i, w in enumerate(words) if i not in gone))}


def test_runs_equal_plain_search():
    rng = random.Random(3)
    for k in range(300):
        letters = rng.choice([1, 2, 2, 3, 5, 40])
        documents = []
        for _ in range(rng.randint(1, 5)):
            words = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(0, 90))]
            if words and rng.random() < 0.7:           # plant periods, some within each other
                for _ in range(rng.randint(1, 3)):
                    a, p = rng.randrange(len(words)), rng.randint(1, 14)
                    piece = words[a:a + p]
                    words[a:a + p] = piece * rng.randint(1, 9)
            documents.append(words)
        assert periodic.runs_of(documents) == [plain_runs(d) for d in documents], k


def test_structured_words():
    fib, b = [b"a"], [b"a", b"b"]
    while len(b) < 400:
        fib, b = b, b + fib
    thue = [b"%d" % (bin(i).count("1") % 2) for i in range(512)]
    same = [b"x"] * 700
    inner = ([b"u"] * 5 + [b"v"]) * 7 + [b"w"]
    nested = inner * 4
    for words in (b, thue, same, nested, nested[3:] + same + thue):
        assert periodic.runs_of([words]) == [plain_runs(words)]


def test_probes_in_small_blocks(monkeypatch):
    words = ([b"a", b"b", b"c"] * 9 + [b"d"]) * 5
    whole = periodic.runs_of([words])
    monkeypatch.setattr(periodic, "BLOCK_PROBES", 7)
    assert periodic.runs_of([words]) == whole == [plain_runs(words)]


def test_rare_words_split_until_nothing_changes():
    # p occurs twice, but on both sides of the single q; its parts fall below the least run length
    words = np.array([0, 1] * 3 + [7, 9, 7] + [0, 1] * 3)
    assert periodic.frequency_segments(words, np.array([len(words)])) == []
    kept = np.array([5] + [0, 1] * 8 + [6])
    assert periodic.frequency_segments(kept, np.array([len(kept)])) == [(1, 17)]


def test_long_text_is_near_linear():
    words = [b"%d" % (i * i % 1009) for i in range(60_000)]       # period 1009 throughout
    (runs,) = periodic.runs_of([words])
    assert (0, 60_000, 1009) in runs


def test_query_equals_plain_answers(spark, tmp_path):
    docs = odd_documents(spark)
    extra = [(100 + i, " ".join(f"w{(i * j) % 7}" for j in range(i))) for i in range(60)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in extra], "doc_id long, text string, lang string, source string, n_chars long"),
                            allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(queries.op13_periodic_runs(spark, str(tmp_path)))
    want = [plain_answer(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: tuple(str(v) for _, v in sorted(r.items()))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r["n_runs"] > 0 for r in got) > 10


def test_whole_small_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in rows_of(queries.op13_periodic_runs(spark, sf))}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        if len(r["text"] or "") < 8000:
            assert got[r["doc_id"]] == plain_answer(r["doc_id"], r["text"])


def test_empty_table(spark):
    assert periodic.periodic_runs(empty_documents(spark)).collect() == []


def test_operator_returns_spans_and_text(spark):
    docs = spark.createDataFrame([(1, "x " + "la di " * 7 + "y")], "doc_id long, text string")
    (row,) = periodic.periodic_runs(docs).collect()
    assert [tuple(r) for r in row["runs"]] == [(1, 14, 2)] and row["collapsed"] == "x la di y"
