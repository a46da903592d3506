import random
import zlib

import numpy as np
from helpers import empty_documents, odd_documents, rows_of
from litsieve.llm import langid
from litsieve.session import read_table


def test_gradients_match_differences(monkeypatch):
    net = {k: v.astype(np.float64) for k, v in langid.new_network(3, 1).items()}
    x, size = langid._pad([b"abc", b"de", b"fghij"])
    target = np.array([[1, 0, 0], [0, 0.5, 0.5], [0, 0, 1.0]])
    weight = np.array([1.0, 2.0, 3.0])

    def loss(n):
        p = langid.position_probabilities(n, x, size)
        mask = (np.arange(x.shape[1])[:, None] < size[None, :])
        each = -(target[None] * np.log(p)).sum(axis=2) * mask * (weight / (size * weight.sum()))[None, :]
        return each.sum()

    grad = langid._gradients(net, x, size, target, weight)
    rng = np.random.default_rng(0)
    for name, g in grad.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in net[name].shape)
            if name == "emb":
                at = (int(x[0, 1]), at[1])
            up, down = ({k: v.copy() for k, v in net.items()} for _ in range(2))
            up[name][at] += 1e-3
            down[name][at] -= 1e-3
            assert abs((loss(up) - loss(down)) / 2e-3 - g[at]) < 2e-4, name


def test_cached_sums_equal_plain_pooling():
    net = langid.new_network(3, 2)
    model = langid.Predictor(net, ["a", "b", "c"])
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdé XYZ.\n") for _ in range(rng.randint(1, 300))) for _ in range(30)] + ["q" * 200]
    got = list(model.batch(texts))
    for text, (lang, score) in zip(texts, got):
        runs = langid.runs_of(text)
        if not langid.has_letter(text):
            assert (lang, score) == ("und", 0.0)
            continue
        assert b"".join(runs).decode() == "".join(c.lower() if c.isascii() else c for c in text if c.isalpha())
        total = sum(langid.position_probabilities(net, *langid._pad([r]))[:, 0].sum(axis=0) for r in runs)
        assert lang == "abc"[int(np.argmax(total))] and abs(score - total.max() / sum(map(len, runs))) < 1e-5


def test_letters():
    assert langid.has_letter("1é") and langid.has_letter("  x") and langid.has_letter("日")
    assert not langid.has_letter("") and not langid.has_letter("12 … 3 !")


def test_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    lang = {r["doc_id"]: r["lang"] for r in rows_of(docs.select("doc_id", "lang"))}
    rows = rows_of(langid.language_id(docs))
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(right) > 0.96


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = rows_of(langid.language_id(docs))
    assert len(rows) == docs.count()
    told = {(r["doc_id"], r["lang_pred"]) for r in rows}
    assert {(3, "und"), (4, "und"), (5, "und"), (9, "und"), (None, "und")} <= told
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert langid.language_id(empty_documents(spark)).count() == 0
    unlabelled = docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in rows_of(langid.language_id(unlabelled))} == {"und"}


def test_pieces_end_between_characters():
    for text in ("日本語" * 20, "aé" * 30, "\U00020000" * 20, "x" * 100, "é" * 12 + "日" * 30):
        runs = langid.runs_of(text)
        assert b"".join(runs).decode() == text and all(len(r) <= langid.RUN_BYTES and r.decode() for r in runs)


def test_script_without_spaces_beside_four_languages(spark):
    """A fifth language of long runs, nearly all of them unique, keeps its share of the training runs."""
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    rng = random.Random(4)
    texts = [(10_000_000 + i, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randint(20, 400))), "zh") for i in range(250)]
    both = docs.unionByName(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    sample, langs = langid.labelled_sample(both)
    per = {r["lang"]: r["count"] for r in langid.training_runs(sample, len(langs)).groupBy("lang").count().collect()}
    assert len(langs) == 5 and per["zh"] >= langid.TRAIN_RUNS // 5
    net, langs = langid.fit(both)
    got = rows_of(langid.identify(both, net, langs))
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    for lang in langs:
        assert np.mean([r["lang_pred"] == lang for r in held if r["lang"] == lang]) > 0.95, lang
    least = langid.rejection_bound(both, net, langs)
    assert 0.2 < least < 0.9 and np.mean([r["score"] >= least for r in held if r["lang_pred"] != "und"]) > 0.99


def test_every_labelled_text_counts(spark):
    """Hundreds of documents of one language: the runs of all that are not held out are counted, none is drawn."""
    rows = [(i, f"word{'abcdefghij'[i % 10]} only", "xx") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = langid.labelled_texts(docs)
    want = docs.where(~langid.held_out(docs.doc_id)).count()
    assert langs == ["xx"] and texts.count() == want
    assert {bytes(r["run"]): r["n"] for r in langid.training_runs(texts, 1).collect()}[b"only"] == want
