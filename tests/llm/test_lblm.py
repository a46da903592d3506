import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import empty_documents, odd_documents, rows_of
from litsieve.llm import lblm
from litsieve.session import read_table


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return low.encode().split() + [lblm.END]


def plain_base(docs):
    out_of = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    c = Counter(t for d in docs if not out_of(d["doc_id"]) for t in tokens(d["text"]))
    n, v = sum(c.values()), len(c)
    for d in docs:
        t = tokens(d["text"])
        yield (d["doc_id"], out_of(d["doc_id"]), len(t), sum(x in c for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t))


def same(docs, rows):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    have = sorted((tuple(r[n] for n in names) for r in rows), key=str)
    for a, b in zip(have, sorted(plain_base(docs), key=str), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


def test_base_counts_and_gain_on_held_out_texts(spark, monkeypatch):
    monkeypatch.setattr(lblm, "KNOWN_WORDS", 3_000)   # most tokens take the join
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = rows_of(lblm.score_documents(docs))
    same(rows_of(docs), rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.05 * sum(r["n_tokens"] for r in held)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    share = rng.random(7) + 0.2
    share /= share.sum()
    net = {k: v.astype(np.float64) for k, v in lblm.initial(7, share).items()}
    two, one, target, noise = (rng.integers(0, 7, n) for n in (9, 9, 9, 5))

    def loss(n):
        h = n["context"][one] @ n["one"] + n["context"][two] @ n["two"]
        shift = np.log(lblm.NOISE_PER_TOKEN * share)
        s = (h * n["output"][target]).sum(1) + (n["bias"] - shift)[target]
        t = h @ n["output"][noise].T + (n["bias"] - shift)[noise]
        return -np.log(lblm._sigmoid(s)).mean() - lblm.NOISE_PER_TOKEN / 5 * np.log(1 - lblm._sigmoid(t)).sum(1).mean()

    grad = lblm.nce_gradients(net, two, one, target, noise, share)
    for name in net:
        at = tuple(rng.integers(0, s) for s in net[name].shape)
        up, down = ({k: v.copy() for k, v in net.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(grad[name][at], abs=1e-5)


def test_probabilities_sum_to_one():
    """Over classes, and within a class over its tokens and the unseen."""
    net = lblm.initial(20, np.full(20, 0.05), 1)
    a, b, z = lblm.log_tables(net)
    for one, two in ((0, 0), (3, 9), (19, 4)):
        assert np.exp(a[one] + b[two] - z[one, two]).sum() == pytest.approx(1)
    known = [(lblm.END, 3)] + [(f"w{i}".encode(), 500 - i) for i in range(450)]
    look = lblm.Lookup(known).load()
    mass = np.ones(lblm.BUCKETS)
    rare = [(w, n) for w, n in known if w not in look.classes]
    for w, n in rare:
        mass[lblm.bucket(w)] += n + 1
    net = lblm.initial(look.size, np.full(look.size, 1 / look.size), 2)
    scorer = lblm.Scorer(look, lblm.log_tables(net), np.log10(mass))
    end = 10 ** scorer.score([""])[3][0]
    total, per_bucket = end, Counter()
    a, b, z = lblm.log_tables(net)
    for w, _ in known[1:]:
        log = scorer.score([w.decode()])[3][0]
        kind = look.classes_of([w])[0]
        after = (a[kind, 0] + b[0, 0] - z[kind, 0]) / math.log(10)
        total += 10 ** (log - after)
    unseen = sum(np.exp(a[0, look.first_bucket + k] + b[0, look.first_bucket + k] - z[0, 0]) / mass[k] for k in range(lblm.BUCKETS))
    assert total + unseen == pytest.approx(1)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = rows_of(lblm.score_documents(docs))
    same(rows_of(docs), rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert lblm.score_documents(empty_documents(spark)).count() == 0


def test_sweep_takes_every_row_by_count():
    count = np.array([1, 1, 2, 1, 900, 40, 1, 1], dtype=np.int64)
    at, weight = lblm.sweep(count, np.random.default_rng(0))
    sums = np.bincount(at, weights=weight, minlength=len(count))
    assert (sums > 0).all() and sums / sums.sum() == pytest.approx(count / count.sum())
    assert weight.mean() == pytest.approx(1) and len(at) <= 2 * len(count)


def test_a_part_is_swept_whole(monkeypatch):
    seen = []
    real = lblm.nce_gradients
    monkeypatch.setattr(lblm, "nce_gradients", lambda net, two, one, target, *a: seen.append((two * 100 + one) * 100 + target) or real(net, two, one, target, *a))
    triple, share = np.arange(500_000, dtype=np.int64), np.full(100, 0.01)    # more than 100 batches
    lblm.train_part(lblm.initial(100, share), triple, np.ones(len(triple), np.int64), share, 1, 0.01)
    assert (np.unique(np.concatenate(seen)) == triple).all()


def test_classes_grow_with_the_tokens():
    assert lblm.words_for(0) == lblm.words_for(10**8) == lblm.WORDS < lblm.words_for(10**9) < lblm.words_for(10**10)
    known = [(b"%d" % i, 10**6 - i) for i in range(2_000)]
    look = lblm.Lookup(known, lblm.words_for(10**9)).load()
    assert look.size == 1_000 and look.classes_of([b"500"])[0] == 501
