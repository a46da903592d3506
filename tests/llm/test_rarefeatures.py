import hashlib
import math

import numpy as np
from helpers import empty_documents, odd_documents, rows_of
from litsieve.llm import rarefeatures as rf
from litsieve.session import read_table


def plain_features(data: bytes, rank) -> list[bytes]:
    """Window by window, as the method says."""
    def level(at):
        w = [int(rf._CLASS[b]) for b in data[at:at + rf.WINDOW]]
        h = np.float32(0)
        for k in range(8):
            c = w.count(k)
            h += np.float32(-c / rf.WINDOW * math.log2(c / rf.WINDOW) if c else 0)
        return min(int(h * np.float32(rf.LEVELS / 3)), rf.LEVELS - 1)

    r = [int(rank[level(i)]) for i in range(len(data) - rf.WINDOW + 1)]
    points = [0] * len(r)
    for at in range(-rf.NEIGHBOURS + 1, len(r)):
        run = [(r[i], i) for i in range(max(at, 0), min(at + rf.NEIGHBOURS, len(r)))]
        if run and min(run)[0] < rf.NEVER:
            points[min(run)[1]] += 1
    return list(dict.fromkeys(data[i:i + rf.WINDOW] for i in range(len(r)) if points[i] >= rf.POINTS))


def test_features_match_plain_form():
    rng = np.random.default_rng(0)
    rank = rng.permutation(rf.LEVELS)
    rank[:rf.LEAST_LEVEL] = rf.NEVER
    words = "the of Haus über and x, 12 qqqq zu.\n été".split(" ")
    texts = [" ".join(rng.choice(words, n)).encode() for n in (1, 3, 9, 40, 200, 7)] + [b"", b"a" * 200, b"x" * 32]
    got = rf.features(texts, rank)
    for text, own in zip(texts, got):
        want = plain_features(text, rank)
        alone = rf.features([text], rank)[0]
        assert (own == alone).all() and len(own) == (len(want) or (1 if text else 0)), text


def test_likeness():
    rng = np.random.default_rng(1)
    a = rf.filters(rng.integers(0, 2**63, 400, dtype=np.uint64))
    b = rf.filters(rng.integers(0, 2**63, 400, dtype=np.uint64))
    none = rf.filters(np.empty(0, np.uint64))
    assert rf.likeness(a, a) == 1 and rf.likeness(a, b) < 0.1 and rf.likeness(a, a[:1]) == 1
    assert rf.likeness(none, none) == 1 and rf.likeness(a, none) == rf.likeness(none, a) == 0


def check(docs, rows):
    docs = sorted(docs, key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, d["text"] is not None, d["text"] or ""))
    want = []
    for d, f in zip(docs, docs[1:] + docs[:1]):
        t, nxt = d["text"] or "", f["text"] or ""
        n = len(t) // 4
        want.append((d["doc_id"], len(t), hashlib.sha256((t[:len(t) - n] + nxt[:n]).encode()).hexdigest()))
    assert sorted(want, key=str) == sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=str)
    print_of, by = {}, {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by[r["doc_id"]] = r
    for d in docs:
        if d["doc_id"] is not None:
            assert print_of.setdefault(d["text"] or "", by[d["doc_id"]]["fingerprint"]) == by[d["doc_id"]]["fingerprint"]
    return by


def test_table(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = rows_of(rf.fingerprints(docs.repartition(5)))
    by = check(rows_of(docs), rows)
    long = [r for r in by.values() if r["n_chars"] > 800]
    assert np.mean([r["near_edited"] for r in long]) > 0.6 and np.mean([r["near_next"] for r in long]) < 0.1
    assert sorted(map(str, rows)) == sorted(map(str, rows_of(rf.fingerprints(docs))))


def test_odd_documents(spark):
    docs = odd_documents(spark)
    by = check(rows_of(docs), rows_of(rf.fingerprints(docs)))
    assert by[3]["fingerprint"] == by[4]["fingerprint"] == "" and by[3]["near_next"] == 1 and by[4]["near_next"] == 0
    one = rows_of(rf.fingerprints(docs.where("doc_id = 6")))
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert rf.fingerprints(empty_documents(spark)).count() == 0


SCRIPTS = {
    "ru": "в начале было слово и город стоял у реки где жили люди много лет назад так",
    "el": "στην αρχή ήταν ο λόγος και η πόλη δίπλα στο ποτάμι όπου ζούσαν πολλοί",
    "ar": "في البداية كانت المدينة على النهر حيث عاش الناس منذ زمن بعيد جدا",
    "zh": "起 初 城 市 在 河 边 人 们 住 了 很 多 年 山 水 风 月 花 鸟 树 木 书 画",
}


def test_other_scripts_have_features(spark):
    """An edited text keeps three quarters of its features, another one shares hardly any, in every script."""
    rng = np.random.default_rng(5)
    rows, texts = [], {}
    for k, (name, words) in enumerate(SCRIPTS.items()):
        for i in range(6):
            joined = ("" if name == "zh" else " ").join(rng.choice(words.split(), 400))
            rows.append((10 * k + i, joined))
            texts[10 * k + i] = name
    rows = [r for i in range(6) for r in rows[i::6]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(rf.fingerprints(docs))
    for name in SCRIPTS:
        own = [r for r in got if texts[r["doc_id"]] == name]
        assert np.mean([r["near_edited"] for r in own]) > 0.5, (name, [r["near_edited"] for r in own])
        assert np.mean([r["near_next"] for r in own]) < 0.2, (name, [r["near_next"] for r in own])
    digits = "".join(map(str, rng.integers(0, 10, 3_000))).encode()
    assert len(rf.features([digits], rf.rarity(docs))[0]) > 20
