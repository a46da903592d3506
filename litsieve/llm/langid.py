"""Language identification by a bidirectional gated recurrent network over bytes.

The bytes of a text are its letters: A-Z lowered, every byte from 0x80 on; all other bytes separate runs.
The network reads each run forwards and backwards from a zero state and labels every position with
probabilities over the learned languages; a document's probability is the mean over all its positions.
As a run's labels depend on the run alone, each worker labels every distinct run once and reuses the sums.
Training is numpy backpropagation through time on the most frequent runs, counted in all labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN_RUNS = 8_000         # distinct (language, run) counts that train it, shared evenly by the languages,
LEAST_RUNS = 500           # but so many of each at least; a language's most frequent come first
MAX_LANGS = 1_000          # languages that one network tells apart, the most frequent
RUN_BYTES = 24             # longer runs are cut into pieces of at most so many bytes, between characters
HIDDEN, EMBED, EPOCHS, BATCH, RATE = 16, 12, 12, 512, 0.012
CACHE_RUNS = 500_000       # sums that a worker keeps; it starts anew when they are full
UNDETERMINED = "und"

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of letter bytes, cut at RUN_BYTES."""
    words = text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    if words and max(map(len, words)) > RUN_BYTES:
        words = [piece for w in words for piece in _pieces(w)]
    return words


def _pieces(word: bytes) -> Iterator[bytes]:
    while len(word) > RUN_BYTES:
        at = RUN_BYTES
        while at > RUN_BYTES - 3 and word[at] & 0xC0 == 0x80:   # inside a character
            at -= 1
        yield word[:at]
        word = word[at:]
    yield word


def has_letter(text: str) -> bool:
    low = text.encode("utf-8", "surrogatepass").translate(_LETTERS)
    return any(97 <= c <= 122 for c in low.lstrip()[:1]) or any(ch.isalpha() for ch in text)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_network(n_langs: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng, net = np.random.default_rng(seed), {}
    net["emb"] = rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)
    for d in "fb":
        net[f"wx_{d}"] = rng.normal(0, EMBED ** -0.5, (EMBED, 3 * HIDDEN)).astype(np.float32)
        net[f"wh_{d}"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        net[f"bias_{d}"] = np.zeros(3 * HIDDEN, np.float32)
    net["out"] = rng.normal(0, 0.1, (2 * HIDDEN, n_langs)).astype(np.float32)
    net["out_bias"] = np.zeros(n_langs, np.float32)
    return net


def _pad(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
    width = int(size.max())
    flat = b"".join(r.ljust(width, b"\0") for r in runs)
    return np.frombuffer(flat, dtype=np.uint8).reshape(len(runs), width), size


def _scan(net, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, HIDDEN) of one direction; padded steps pass the state on."""
    steps, n = x.shape[1], len(x)
    table = net["emb"] @ net[f"wx_{d}"] + net[f"bias_{d}"]
    wh, H = net[f"wh_{d}"], HIDDEN
    h, states = np.zeros((n, H), np.float32), np.empty((steps, n, H), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        gx = table.take(x[:, t], axis=0)
        gates = _sigmoid(gx[:, :2 * H] + h @ wh[:, :2 * H])
        z, r = gates[:, :H], gates[:, H:]
        c = np.tanh(gx[:, 2 * H:] + (r * h) @ wh[:, 2 * H:])
        m = mask[:, t:t + 1]
        new = h + m * z * (c - h)
        if keep is not None:
            keep.append((t, h, z, r, c, m))
        states[t] = h = new
    return states


def position_probabilities(net, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(time, batch, languages): the label probabilities of every position (padding included)."""
    mask = (np.arange(x.shape[1])[None, :] < size[:, None]).astype(np.float32)
    both = np.concatenate((_scan(net, "f", x, mask), _scan(net, "b", x, mask)), axis=2)
    logits = both @ net["out"] + net["out_bias"]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    return p / p.sum(axis=2, keepdims=True)


def run_sums(net, runs: list[bytes]) -> np.ndarray:
    """Per run: the sum of its positions' probabilities, one column a language."""
    out = np.empty((len(runs), len(net["out_bias"])), np.float32)
    order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
    for at in range(0, len(order), 4096):
        some = order[at:at + 4096]
        x, size = _pad([runs[i] for i in some])
        p = position_probabilities(net, x, size)
        p *= (np.arange(x.shape[1])[:, None] < size[None, :])[:, :, None]
        out[some] = p.sum(axis=0)
    return out


def _gradients(net, x, size, target, weight):
    """Cross-entropy of every position against the run's label distribution, backpropagated through time."""
    H, (n, steps) = HIDDEN, x.shape
    mask = (np.arange(steps)[None, :] < size[:, None]).astype(np.float32)
    kept = {"f": [], "b": []}
    both = np.concatenate((_scan(net, "f", x, mask, kept["f"]), _scan(net, "b", x, mask, kept["b"])), axis=2)
    logits = both @ net["out"] + net["out_bias"]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    scale = (mask * (weight / (size * weight.sum()))[:, None]).T[:, :, None]
    d_logits = (p - target[None]) * scale
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    grad["out"] = np.tensordot(both, d_logits, ((0, 1), (0, 1)))
    grad["out_bias"] = d_logits.sum(axis=(0, 1))
    d_both = d_logits @ net["out"].T
    for d, part in (("f", d_both[:, :, :H]), ("b", d_both[:, :, H:])):
        wh, carry = net[f"wh_{d}"], np.zeros((n, H), np.float32)
        d_table = np.zeros((256, 3 * H), np.float32)
        for t, h, z, r, c, m in reversed(kept[d]):
            dh = carry + part[t]
            dm = dh * m
            d_c = dm * z * (1 - c * c)
            d_z = dm * (c - h) * z * (1 - z)
            d_rh = d_c @ wh[:, 2 * H:].T
            d_r = d_rh * h * r * (1 - r)
            d_zr = np.concatenate((d_z, d_r), axis=1)
            grad[f"wh_{d}"][:, :2 * H] += h.T @ d_zr
            grad[f"wh_{d}"][:, 2 * H:] += (r * h).T @ d_c
            np.add.at(d_table, x[:, t], np.concatenate((d_zr, d_c), axis=1))
            carry = dh - dm * z + d_zr @ wh[:, :2 * H].T + d_rh * r
        grad[f"wx_{d}"] = net["emb"].T @ d_table
        grad[f"bias_{d}"] = d_table.sum(axis=0)
        grad["emb"] += d_table @ net[f"wx_{d}"].T
    return grad


def train(counts: list[tuple[str, bytes, int]], langs: list[str], epochs: int = EPOCHS, seed: int = 7):
    """Adam over (language, run, count); each run's target is its smoothed language distribution."""
    at, of = {}, {lang: i for i, lang in enumerate(langs)}
    total = np.zeros(len(langs))
    for lang, run, n in counts:
        total[of[lang]] += n
        row = at.setdefault(run, np.zeros(len(langs), np.float32))
        row[of[lang]] += n
    runs = sorted(at)
    seen = np.stack([at[r] for r in runs]) / np.maximum(total, 1).astype(np.float32)  # languages count alike
    target = seen / seen.sum(axis=1, keepdims=True)
    weight = np.sqrt(np.stack([at[r] for r in runs]).sum(axis=1))
    net, rng = new_network(len(langs), seed), np.random.default_rng(seed)
    m1 = {k: np.zeros_like(v) for k, v in net.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.items()}
    by_size = np.array(sorted(range(len(runs)), key=lambda i: (len(runs[i]), runs[i])))
    blocks, step = [by_size[i:i + BATCH] for i in range(0, len(by_size), BATCH)], 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + RATE / 20
        for j in rng.permutation(len(blocks)):
            some, step = blocks[j], step + 1
            x, size = _pad([runs[i] for i in some])
            grad = _gradients(net, x, size, target[some], weight[some].astype(np.float32))
            for k, g in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                net[k] = (net[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter
    for batch in batches:
        per: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            per.setdefault(lang, Counter()).update(runs_of(text or ""))
        rows = [(lang, run, n) for lang, c in per.items() for run, n in c.items()]
        if rows:
            lang, run, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(run, pa.binary()), pa.array(n, pa.int64())], names=["lang", "run", "n"])


def labelled_texts(docs: DataFrame) -> tuple[DataFrame | None, list[str]]:
    """(lang, text of every document with a non-null label that is not held out, languages)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not sizes:
        return None, []
    langs = sorted(r["lang"] for r in sizes)
    return known.where(F.col("lang").isin(langs)).select("lang", "text"), langs


labelled_sample = labelled_texts   # the name from when it drew some


def training_runs(texts: DataFrame, n_langs: int) -> DataFrame:
    """lang, run, n, counted in all texts: the most frequent runs of each language, as many of each, so that a language of few or of
    long runs (a script without spaces) keeps its share beside large ones."""
    each = max(LEAST_RUNS, TRAIN_RUNS // n_langs)
    counts = texts.mapInArrow(_count_runs, "lang string, run binary, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "run"))
    return counts.withColumn("_place", place).where(F.col("_place") <= each).drop("_place")


def fit(docs: DataFrame):
    """(network, languages) from docs(doc_id, text, lang): the runs of all labelled texts are counted, and only the
    most frequent reach the driver. Without labelled rows: (None, [])."""
    texts, langs = labelled_texts(docs)
    if texts is None:
        return None, []
    counts = training_runs(texts, len(langs)).orderBy(F.desc("n"), "lang", "run").collect()
    if not counts:
        return None, []
    return train([(r["lang"], bytes(r["run"]), r["n"]) for r in counts], langs), langs


def rejection_bound(docs: DataFrame, net, langs: list[str]) -> float:
    """The score below which a text counts as of none of the languages: a quarter of the way from chance (one over
    their number) to the score that all but a hundredth of the rightly told labelled texts reach (to four places,
    which bounds the percentile's memory), so that short and noisy texts of a known language stay. With one language
    every text of letters scores 1, so nothing is rejected."""
    if len(langs) < 2:
        return 0.0
    texts, _ = labelled_texts(docs)
    told = identify(texts, net, langs).where("lang = lang_pred")
    low = told.agg(F.percentile(F.round("score", 4), F.lit(0.01)).alias("low")).first()["low"]
    chance = 1.0 / len(langs)
    return 0.0 if low is None else chance + max(low - chance, 0.0) / 4


class Predictor:
    """Pools run sums into documents; a worker keeps the sums of the runs it has seen."""

    def __init__(self, net, langs):
        self.net, self.langs, self.at = net, langs, {}
        self.sums = np.empty((0, len(langs)), np.float32)

    def __getstate__(self):
        return self.net, self.langs

    def __setstate__(self, state):
        self.__init__(*state)

    def _rows(self, runs: list[bytes]) -> np.ndarray:
        """The places of the runs' sums."""
        if len(self.at) > CACHE_RUNS:
            self.at = {}
        places = list(map(self.at.get, runs))
        if None in places:
            new = list({r for r, k in zip(runs, places) if k is None})
            first = len(self.at)
            if first + len(new) > len(self.sums):
                more = np.empty((max(first + len(new), 2 * len(self.sums)), len(self.langs)), np.float32)
                more[:first] = self.sums[:first]
                self.sums = more
            self.sums[first:first + len(new)] = run_sums(self.net, new)
            self.at.update(zip(new, range(first, first + len(new))))
            places = map(self.at.__getitem__, runs)
        return np.fromiter(places, dtype=np.int64, count=len(runs))

    def _answer(self, text, pooled, n):
        if text is None or not self.langs or not n or not has_letter(text):
            return UNDETERMINED, 0.0
        best = int(np.argmax(pooled))
        return self.langs[best], float(min(1.0, pooled[best] / n))

    def _together(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        if not self.langs:
            yield from ((UNDETERMINED, 0.0) for _ in texts)
            return
        per = [runs_of(t) if t else [] for t in texts]
        flat = [r for runs in per for r in runs]
        doc = np.repeat(np.arange(len(per)), list(map(len, per)))
        pooled = np.zeros((len(per), len(self.langs)))
        size = np.bincount(doc, weights=list(map(len, flat)), minlength=len(per))
        for at in range(0, len(flat), 1 << 18):  # a slice at a time, as one text can be very long
            owner = doc[at:at + (1 << 18)]
            places = self._rows(flat[at:at + (1 << 18)])
            rows = self.sums[places]
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            np.add.at(pooled, owner[start], np.add.reduceat(rows, start, axis=0, dtype=np.float64))
        for k, text in enumerate(texts):
            yield self._answer(text, pooled[k], size[k])

    def batch(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """Documents together, about 2 million characters at a time, so that new runs fill whole matrices."""
        todo, chars = [], 0
        for t in texts:
            todo.append(t)
            chars += len(t or "")
            if chars >= 1 << 21:
                yield from self._together(todo)
                todo, chars = [], 0
        yield from self._together(todo)

    def predict(self, text: str | None) -> tuple[str, float]:
        return next(self._together([text]))


def identify(docs: DataFrame, net, langs, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the prediction and its score added to every row under ``names``, from the column text alone.
    Columns of docs that have these names give way."""
    model = Predictor(net, langs)
    kept = [c for c in docs.columns if c not in names]
    docs = docs.select(*kept)
    schema = T.StructType(docs.schema.fields + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    at = docs.columns.index("text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(model.batch(batch.column(at).to_pylist()))
            extra = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(list(batch.columns) + extra, names=[*kept, *names])

    return docs.mapInArrow(label, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, held_out, lang_pred, score: one row per input row.

    A null text, or one without any letter, is ``und`` with score 0, as is everything when no labelled
    row exists; a null doc_id counts as empty text in the fold rule; score ties go to the first language
    by name; repeated rows each return a row; an empty table returns no rows.
    """
    from litsieve.llm.common import columns
    docs = columns(docs, doc_id="long", text="string", lang="string")
    net, langs = fit(docs)
    out = identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), net, langs)
    return out.select("doc_id", "held_out", "lang_pred", "score")
