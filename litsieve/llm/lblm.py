"""Log-bilinear language model trained with noise-contrastive estimation.

Vocabulary: every training token. The WORDS most frequent tokens (more in a large corpus: as many classes as the
cube root of its tokens) are classes of their own, all others fall into BUCKETS classes by their last two bytes. A log-bilinear network predicts the next class from the two
before (context vectors times a matrix per position, dotted with an output vector, plus a bias); a rare
token's share of its class is its count plus one, one more unit of each class standing for unseen tokens.
The network learns from the counts of all class triples of the training texts: the table is bounded by
classes cubed, its parts grow in number with its rows, each trainer task sweeps its whole part every round,
frequent triples in several steps, and parameters are averaged between rounds. The normaliser over all classes is exact: with E1 = exp(position-1 scores + bias)
and E2 = exp(position-2 scores), Z = E1 E2' for all pairs of context classes in one matrix product.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.llm.common import columns, cut_lineage

WORDS, BUCKETS = 415, 96           # with the end of text: 512 classes
KNOWN_WORDS = 150_000              # most frequent tokens whose counts every task holds (at most KNOWN_BYTES each)
KNOWN_BYTES = 64
DIM, TRAINERS, ROUNDS, BATCH, NOISE, RATE = 32, 8, 3, 4096, 64, 0.02
PART_ROWS = 2_000_000              # triples of a trainer task, of which there are TRAINERS at least
NOISE_PER_TOKEN = 16
END = b"\n"                        # no word holds white space
FLUSH = 300_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(c):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            seen.update(words_of(text.as_py()))
            seen[END] += 1
            if len(seen) > FLUSH:
                yield rows(seen)
                seen = Counter()
    if seen:
        yield rows(seen)


class Lookup:
    """Class, and log10 of count + 1, of the known tokens; a worker builds its dictionary once."""

    def __init__(self, known: list[tuple[bytes, int]], words: int | None = None):
        self.known, self.words, self.at = known, WORDS if words is None else words, None
        names = [w for w, _ in known if w != END][:self.words]
        self.classes = {END: 0} | {w: i + 1 for i, w in enumerate(names)}
        self.first_bucket, self.size = len(self.classes), len(self.classes) + BUCKETS

    def __getstate__(self):
        return self.known, self.words

    def __setstate__(self, state):
        self.__init__(*state)

    def load(self):
        if self.at is None:
            self.at = {w: i for i, (w, _) in enumerate(self.known)}
            self.log = np.log10(np.array([n for _, n in self.known], dtype=np.float64) + 1)
            self.kind = np.array([self.classes[w] if w in self.classes else self.first_bucket + bucket(w) for w, _ in self.known], dtype=np.int64)
        return self

    def classes_of(self, words: list[bytes]) -> np.ndarray:
        self.load()
        at = list(map(self.at.get, words))
        out = np.empty(len(words), np.int64)
        known = np.array([k is not None for k in at], bool)
        out[known] = self.kind[[k for k in at if k is not None]]
        out[~known] = [self.first_bucket + bucket(words[i]) for i in np.flatnonzero(~known)]
        return out


def words_for(tokens: int) -> int:
    """Words that are classes of their own in a corpus of so many tokens: WORDS, or cube root of tokens classes."""
    return max(WORDS, min(KNOWN_WORDS, round(tokens ** (1 / 3)) - BUCKETS - 1))


def _context(classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two places back; before a text there are only ends (class 0)."""
    one, two = np.zeros_like(classes), np.zeros_like(classes)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    one[starts] = two[starts] = 0
    after = starts + 1
    two[after[after < len(classes)]] = 0
    return one, two


def _stream(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All tokens of the texts, each text closed by END; lengths; starts."""
    tokens, size = [], []
    for t in texts:
        words = words_of(t)
        tokens += words
        tokens.append(END)
        size.append(len(words) + 1)
    size = np.array(size, dtype=np.int64)
    return tokens, size, np.cumsum(size) - size


def _portions(batch: pa.RecordBatch, column: int, chars: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    first, some, n = 0, [], 0
    for k, text in enumerate(batch.column(column).to_pylist()):
        some.append(text)
        n += len(text or "")
        if n >= chars:
            yield first, some
            first, some, n = k + 1, [], 0
    if some:
        yield first, some


def _triples(batches: Iterator[pa.RecordBatch], lookup: Lookup) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def rows():
        key, count = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(count.astype(np.int64))], names=["triple", "n"])

    for batch in batches:
        for _, texts in _portions(batch, 0):
            tokens, _, starts = _stream(texts)
            c = lookup.classes_of(tokens)
            one, two = _context(c, starts)
            held.append((two * lookup.size + one) * lookup.size + c)
            n += len(c)
            if n > 2_000_000:
                yield rows()
                held, n = [], 0
    if held:
        yield rows()


def initial(size: int, share: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    return {"context": draw(size, DIM), "output": draw(size, DIM), "one": np.eye(DIM, dtype=np.float32) + draw(DIM, DIM) / 4,
            "two": np.eye(DIM, dtype=np.float32) / 2 + draw(DIM, DIM) / 4, "bias": np.log(share).astype(np.float32)}


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """np.add.at(out, at, rows), by sorting."""
    order = np.argsort(at, kind="stable")
    places = at[order]
    first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
    out[places[first]] += np.add.reduceat(rows[order], first, axis=0)


def nce_gradients(net, two, one, target, noise, share, weight=1.0):
    """Noise-contrastive gradients: targets against NOISE_PER_TOKEN draws each, the batch sharing ``noise``;
    ``weight``: how much each target counts."""
    a, b = net["context"][one], net["context"][two]
    h = a @ net["one"] + b @ net["two"]
    k = NOISE_PER_TOKEN
    shift = np.log(k * share)
    s = np.einsum("ij,ij->i", h, net["output"][target]) + net["bias"][target] - shift[target]
    t = h @ net["output"][noise].T + (net["bias"] - shift)[noise][None, :]
    each = np.broadcast_to(weight, len(target)) / len(target)
    ds = ((_sigmoid(s) - 1) * each).astype(np.float32)
    dt = (_sigmoid(t) * (k / len(noise) * each)[:, None]).astype(np.float32)
    dh = ds[:, None] * net["output"][target] + dt @ net["output"][noise]
    grad = {n: np.zeros_like(v) for n, v in net.items()}
    _add_rows(grad["output"], target, ds[:, None] * h)
    _add_rows(grad["output"], noise, dt.T @ h)
    _add_rows(grad["bias"], target, ds)
    _add_rows(grad["bias"], noise, dt.sum(axis=0))
    grad["one"], grad["two"] = a.T @ dh, b.T @ dh
    _add_rows(grad["context"], one, dh @ net["one"].T)
    _add_rows(grad["context"], two, dh @ net["two"].T)
    return grad


def sweep(count: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(rows, weights) of one sweep in random order: every row, one of more than the mean count in several places
    that share its count; weights are 1 on average and sum in proportion to the counts."""
    times = np.maximum(1, -(-count * len(count) // count.sum()))
    at = rng.permutation(np.repeat(np.arange(len(count)), times))
    weight = (count / times)[at]
    return at, weight / weight.mean()


def train_part(net, triple: np.ndarray, count: np.ndarray, share: np.ndarray, seed: int, rate: float):
    """Adam steps over one sweep of one trainer's part of the table."""
    net, size, rng = {k: v.copy() for k, v in net.items()}, len(share), np.random.default_rng(seed)
    draws = np.cumsum(share)
    rows, weight = sweep(count, rng)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    for step, first in enumerate(range(0, len(rows), BATCH), 1):
        at = triple[rows[first:first + BATCH]]
        noise = np.minimum(np.searchsorted(draws, rng.random(NOISE)), size - 1)
        grad = nce_gradients(net, at // size // size, at // size % size, at % size, noise, share, weight[first:first + BATCH])
        for k, g in grad.items():
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            net[k] = (net[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def train(triples: DataFrame, share: np.ndarray) -> dict[str, np.ndarray]:
    """Rounds of one task for each ``part`` of triples(triple, n, part), each a sweep of the part; a parameter set
    of a fixed size a part comes back to be averaged by tokens seen."""
    net = initial(len(share), share)
    names = list(net)
    for turn in range(ROUNDS):
        start, rate = net, RATE * 0.4 ** turn

        def fit(table: pa.Table) -> pa.Table:
            table = table.sort_by("triple")
            part, n = table["part"][0].as_py(), table["n"].to_numpy()
            out = train_part(start, table["triple"].to_numpy(), n, share, 1000 * turn + part, rate)
            return pa.table({"n": pa.array([int(n.sum())], pa.int64()), "net": pa.array([b"".join(out[k].tobytes() for k in names)], pa.binary())})

        got = triples.groupBy("part").applyInArrow(fit, "n long, net binary").collect()
        if not got:
            return net
        total, flat = sum(r["n"] for r in got), 0
        for r in sorted(got, key=lambda r: (r["n"], bytes(r["net"]))):
            flat = flat + np.frombuffer(bytes(r["net"]), dtype=np.float32).astype(np.float64) * (r["n"] / total)
        at, net = 0, {}
        for k in names:
            net[k] = flat[at:at + start[k].size].reshape(start[k].shape).astype(np.float32)
            at += start[k].size
    return net


def log_tables(net) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A, B, Z), natural logs: log P(c | two, one) = A[one, c] + B[two, c] - Z[one, two]."""
    wide = {k: v.astype(np.float64) for k, v in net.items()}
    a = wide["context"] @ wide["one"] @ wide["output"].T + wide["bias"]
    b = wide["context"] @ wide["two"] @ wide["output"].T
    top_a, top_b = a.max(axis=1), b.max(axis=1)
    z = np.log(np.exp(a - top_a[:, None]) @ np.exp(b - top_b[:, None]).T) + top_a[:, None] + top_b[None, :]
    return a, b, z


class Scorer:
    def __init__(self, lookup: Lookup, tables, class_log: np.ndarray):
        self.lookup, self.tables, self.class_log = lookup, tables, class_log

    def score(self, texts: list[str | None]):
        """Per text: tokens, known tokens, sum of log10(count + 1) of the known, model score without the
        shares of tokens that this task does not know, and those tokens with their counts."""
        look = self.lookup.load()
        tokens, size, starts = _stream(texts)
        at = list(map(look.at.get, tokens))
        known = np.fromiter((k is not None for k in at), dtype=bool, count=len(at))
        place = np.array([0 if k is None else k for k in at], dtype=np.int64)
        kind = look.kind[place]
        missing = np.flatnonzero(~known)
        kind[missing] = [look.first_bucket + bucket(tokens[i]) for i in missing]
        one, two = _context(kind, starts)
        a, b, z = self.tables
        log = (a[one, kind] + b[two, kind] - z[one, two]) / np.log(10)
        counted = np.where(known, look.log[place], 0.0)
        rare = kind >= look.first_bucket
        log += np.where(rare, counted - self.class_log[np.maximum(kind - look.first_bucket, 0)], 0.0)
        sums = [np.add.reduceat(x.astype(np.float64), starts) for x in (known, counted, log)]
        owner = np.searchsorted(starts, missing, side="right") - 1
        tail: list[Counter] = [Counter() for _ in texts]
        for i, d in zip(missing, owner):
            tail[d][tokens[i]] += 1
        return size, sums[0].astype(np.int64), sums[1], sums[2], tail

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _portions(batch, 1):
                size, known, counted, log, tail = self.score(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(size), pa.array(known), pa.array(counted), pa.array(log),
                     pa.array([list(t) for t in tail], pa.list_(pa.binary())), pa.array([list(t.values()) for t in tail], pa.list_(pa.int64()))],
                    names=["doc_id", "n_tokens", "known", "counted", "log", "words", "times"])


def most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The end and the most frequent words of at most KNOWN_BYTES: as many whole frequency steps as KNOWN_WORDS
    holds. Only the steps' sizes (64 an octave) and the words taken come to the driver."""
    step = F.floor(F.log2("n") * 64).cast("int")
    short = counts.where(F.octet_length("word") <= KNOWN_BYTES)
    least, total = None, 0
    for r in sorted(short.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > KNOWN_WORDS:
            break
        least = r["step"]
    chosen = (F.col("word") == F.lit(END)) if least is None else (step >= least) | (F.col("word") == F.lit(END))
    got = [(bytes(r["word"]), r["n"]) for r in short.where(chosen).collect()] or [(END, 0)]
    return sorted(got, key=lambda x: (-x[1], x[0]))


def score_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per
    input row, whole texts, learning from the documents that are not held out.

    A null or empty text is the end token alone; a null doc_id counts as empty text in the fold rule; repeated
    rows each return a row; ties among equally frequent words go by their bytes; without any training document
    every token is unseen (N = V = 0) and base_score is 0; an empty table gives no rows.
    """
    docs = columns(docs, doc_id="long", text="string")
    training = docs.where(~held_out(F.col("doc_id"))).select("text")
    counts = cut_lineage(training.mapInArrow(_count_tokens, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    known = most_frequent(counts)
    lookup = Lookup(known, words_for(n_all))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(lookup)                      # at most KNOWN_WORDS * KNOWN_BYTES

    triples = training.mapInArrow(lambda it: _triples(it, shared.value), "triple long, n long")
    triples = cut_lineage(triples.groupBy("triple").agg(F.sum("n").alias("n")))
    share, rows = np.ones(lookup.size), 0
    for r in triples.groupBy((F.col("triple") % lookup.size).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect():  # one row a class
        share[r["c"]] += r["n"]
        rows += r["rows"]
    share /= share.sum()
    parts = max(TRAINERS, -(-rows // PART_ROWS))
    net = train(triples.withColumn("part", F.pmod(F.xxhash64("triple"), F.lit(parts)).cast("int")), share)

    own = [w for w, c in lookup.classes.items()]
    in_class = F.pmod(F.crc32(F.expr("substring(word, greatest(octet_length(word) - 1, 1), 2)")), F.lit(BUCKETS)).cast("int")
    mass = np.ones(BUCKETS)                                  # one unit for unseen tokens
    for r in (counts.withColumn("bucket", in_class).groupBy("bucket").agg(F.sum(F.col("n") + 1).alias("n")).collect()):
        mass[r["bucket"]] += r["n"]
    count_of = dict(known[:lookup.words + 1] + [k for k in known if k[0] == END])
    for w in own:
        if w in count_of and count_of[w]:
            mass[bucket(w)] -= count_of[w] + 1
    scorer = context.broadcast(Scorer(lookup, log_tables(net), np.log10(mass)))

    scored = docs.select("doc_id", "text").mapInArrow(
        lambda it: scorer.value.batches(it),
        "doc_id long, n_tokens long, known long, counted double, log double, words array<binary>, times array<long>")
    scored = cut_lineage(scored.withColumn("_row", F.monotonically_increasing_id()))
    tail = scored.select("_row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("_row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    tail = tail.join(counts, "word").groupBy("_row").agg(
        F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("_counted"))
    more, found = F.coalesce("_counted", F.lit(0.0)), F.coalesce("_known", F.lit(0))
    return scored.drop("words", "times").join(tail, "_row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + found if n_all else F.lit(0).cast("long")).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("counted") + more - F.col("n_tokens") * F.log10(F.lit(float(n_all + v_all + 1)))).alias("base_score"),
        (F.col("log") + more).alias("score"))
