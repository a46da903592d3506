"""Line de-duplication by a sharded minimal perfect hash over the distinct lines of a corpus.

Every line's key is hashed to 128 bits. Distinct hashes, with the number of documents that hold them and the
largest of their ids, are dealt to shards of about SHARD_KEYS; each shard becomes one row: a minimal perfect
hash (a cascade of bit arrays: at each level a key alone in its slot is settled, the others go on), and, at
its index, a fingerprint, the count and the id. Documents go by in chunks; a chunk asks each shard once for
each of its distinct lines, so a line of a third of all documents is asked for once a chunk. Shards and
questions meet sorted by shard, one shard's arrays in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.llm.common import columns, cut_lineage, shuffle_width

LEAST_CHARS, LEAST_DOCS = 20, 3
CHUNK_LINES = 1 << 15
SHARD_KEYS = 1 << 14
SPREAD = 1.6                # slots a key at each level of the hash
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: ASCII white space stripped, A-Z lower-cased, other characters as they are."""
    return [line.strip().lower() for line in text.split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    """Whether a key has ``least`` code points (four bytes at most each)."""
    return len(key) >= least and (len(key) >= 4 * least or sum(b & 0xC0 != 0x80 for b in key) >= least)


def line_hash(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


# ------------------------------------------------------------------- minimal perfect hash of one shard

def _slot(h1: np.ndarray, h2: np.ndarray, level: int, slots: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h1 ^ (h2 * _A)) + np.uint64(level + 1) * _C
        x = (x ^ (x >> np.uint64(31))) * _B
        x = (x ^ (x >> np.uint64(29))) * _C
        return ((x ^ (x >> np.uint64(32))) % np.uint64(slots)).astype(np.int64)


def build_hash(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """Bit array of each level; a key's index is the rank of its slot among all set bits. Keys are distinct."""
    levels = []
    while len(h1):
        slots = max(64, int(len(h1) * SPREAD))
        slot = _slot(h1, h2, len(levels), slots)
        alone = np.bincount(slot, minlength=slots)[slot] == 1
        bits = np.zeros(slots, dtype=bool)
        bits[slot[alone]] = True
        levels.append(bits)
        h1, h2 = h1[~alone], h2[~alone]
    return levels


def find(levels: list[np.ndarray], ranks: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Index of each key; -1 for some of the keys that the hash was not built of (others get any index)."""
    index = np.full(len(h1), -1, dtype=np.int64)
    left = np.arange(len(h1))
    for level, (bits, rank) in enumerate(zip(levels, ranks)):
        if not len(left):
            break
        slot = _slot(h1[left], h2[left], level, len(bits))
        hit = bits[slot]
        index[left[hit]] = rank[slot[hit]]
        left = left[~hit]
    return index


def rank_levels(levels: list[np.ndarray]) -> list[np.ndarray]:
    ranks, before = [], 0
    for bits in levels:
        ranks.append(before + np.cumsum(bits) - 1)
        before += int(bits.sum())
    return ranks


class Shard:
    """The arrays of one shard, from its row."""

    def __init__(self, slots, bits, fingerprints, count_type, counts, last_ids):
        self.levels, at = [], 0
        for n in slots:
            packed = np.frombuffer(bits, np.uint8, (n + 7) // 8, at)
            self.levels.append(np.unpackbits(packed, count=n).astype(bool))
            at += len(packed)
        self.ranks = rank_levels(self.levels)
        self.fingerprints = np.frombuffer(fingerprints, np.uint64)
        self.counts, self.last_ids = np.frombuffer(counts, count_type), np.frombuffer(last_ids, np.int64)

    @staticmethod
    def pack(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, last_ids: np.ndarray) -> dict:
        levels = build_hash(h1, h2)
        order = np.argsort(find(levels, rank_levels(levels), h1, h2))
        counts = counts[order].astype(np.min_scalar_type(int(counts.max(initial=0))))
        return {"slots": [len(b) for b in levels], "bits": b"".join(np.packbits(b).tobytes() for b in levels),
                "fingerprints": h2[order].tobytes(), "count_type": counts.dtype.str, "counts": counts.tobytes(),
                "last_ids": last_ids[order].tobytes()}

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of documents, largest id) of each line; zero documents for a line that is not in the shard."""
        index = find(self.levels, self.ranks, h1, h2)
        known = index >= 0
        known[known] = self.fingerprints[index[known]] == h2[known]
        counts, last = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        counts[known], last[known] = self.counts[index[known]], self.last_ids[index[known]]
        return counts, last


SHARD = "shard int, slots array<bigint>, bits binary, fingerprints binary, count_type string, counts binary, last_ids binary"
_PARTS = ("slots", "bits", "fingerprints", "count_type", "counts", "last_ids")


# ------------------------------------------------------------------- tables

def line_table(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs(doc_id, text_hash, text binary) -> chunk, doc_id, text_hash, h1, h2, first: each distinct long line
    of a document, first where its chunk has not held the line before. Chunks end with a document."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def rows(held):
            owner = np.repeat(np.arange(len(held)), [len(h) // 16 for _, _, h, _ in held])
            pair = np.frombuffer(b"".join(h for _, _, h, _ in held), "<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(len(owner), (part << 32) + number)), pa.array([d for d, _, _, _ in held], pa.int64()).take(pa.array(owner)),
                pa.array([t for _, t, _, _ in held], pa.int64()).take(pa.array(owner)), pa.array(pair[:, 0]), pa.array(pair[:, 1]),
                pa.array([f for _, _, _, first in held for f in first], pa.bool_())], ["chunk", "doc_id", "text_hash", "h1", "h2", "first"])

        held, seen, n = [], set(), 0
        for batch in batches:
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                hashes = dict.fromkeys(line_hash(k) for k in line_keys(text.as_py() or b"") if long_enough(k, least_chars))
                if not hashes:
                    continue
                held.append((doc_id, text_hash, b"".join(hashes), [h not in seen for h in hashes]))
                seen.update(hashes)
                n += len(hashes)
                if n >= CHUNK_LINES:
                    yield rows(held)
                    held, seen, n, number = [], set(), 0, number + 1
        if held:
            yield rows(held)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(lines, "chunk long, doc_id long, text_hash long, h1 long, h2 long, first boolean")


def line_counts(lines: DataFrame) -> DataFrame:
    """h1, h2, n_docs (distinct ids; all null ids are one), last_id: pairs of line and document first, so that
    a frequent line is counted by all tasks before it meets in one."""
    pairs = lines.select("h1", "h2", "doc_id").distinct()
    return pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_id"))


def hash_shards(counts: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the minimal perfect hash of its lines and the arrays that it indexes."""
    def build(table: pa.Table) -> pa.Table:
        h1, h2, n, last = (table.column(c).to_numpy() for c in ("h1", "h2", "n_docs", "last_id"))
        row = Shard.pack(h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64), n, last.astype(np.int64))
        return pa.Table.from_pylist([{"shard": table.column("shard")[0].as_py(), **row}], schema=pa.schema([
            ("shard", pa.int32()), ("slots", pa.list_(pa.int64())), ("bits", pa.binary()), ("fingerprints", pa.binary()),
            ("count_type", pa.string()), ("counts", pa.binary()), ("last_ids", pa.binary())]))

    dealt = counts.select(_shard(shards), "h1", "h2", "n_docs", F.coalesce("last_id", F.lit(0)).alias("last_id"))
    return dealt.groupBy("shard").applyInArrow(build, SHARD)


def _shard(shards: int):
    return F.pmod(F.xxhash64("h1"), F.lit(shards)).cast("int").alias("shard")


def probe_shards(lines: DataFrame, shards: DataFrame, n_shards: int, least_docs: int = LEAST_DOCS) -> DataFrame:
    """chunk, h1, h2, last_id of the lines in at least ``least_docs`` documents: each chunk's lines asked once."""
    asked = lines.where("first").select(_shard(n_shards), "chunk", "h1", "h2")
    both = shards.withColumns({"chunk": F.lit(None).cast("long"), "h1": F.lit(None).cast("long"), "h2": F.lit(None).cast("long")}).unionByName(
        asked, allowMissingColumns=True)
    met = both.repartition(shuffle_width(lines), "shard").sortWithinPartitions("shard", F.col("bits").isNull())   # arrays come first

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            arrays = ~np.asarray(batch.column("bits").is_null())
            cuts = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | arrays[1:] | arrays[:-1]])
            for low, high in zip(cuts, np.r_[cuts[1:], len(numbers)]):
                if arrays[low]:
                    number, shard = numbers[low], Shard(*(batch.column(c)[int(low)].as_py() for c in _PARTS))
                    continue
                assert number == numbers[low]
                piece = batch.slice(low, high - low)
                h1, h2 = (piece.column(c).to_numpy() for c in ("h1", "h2"))
                n, last = shard.probe(h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64))
                hit = n >= least_docs
                yield pa.RecordBatch.from_arrays([piece.column("chunk").filter(pa.array(hit)), pa.array(h1[hit].astype(np.int64)),
                                                  pa.array(h2[hit].astype(np.int64)), pa.array(last[hit])], ["chunk", "h1", "h2", "last_id"])

    return met.mapInArrow(answer, "chunk long, h1 long, h2 long, last_id long")


def lines_to_drop(lines: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, text_hash, drops: the hashes that a document loses, from the answers to its chunk."""
    def decide(chunk: pa.Table, known: pa.Table) -> pa.Table:
        last = {(a, b): c for a, b, c in zip(known.column("h1").to_pylist(), known.column("h2").to_pylist(), known.column("last_id").to_pylist())}
        drops: dict[tuple, list] = {}
        for doc_id, text_hash, a, b in zip(*(chunk.column(c).to_pylist() for c in ("doc_id", "text_hash", "h1", "h2"))) if last else ():
            if (a, b) in last and last[a, b] != doc_id:
                drops.setdefault((doc_id, text_hash), []).append(np.array([a, b], "<i8").tobytes())
        return pa.Table.from_arrays([pa.array([k[0] for k in drops], pa.int64()), pa.array([k[1] for k in drops], pa.int64()),
                                     pa.array([b"".join(dict.fromkeys(v)) for v in drops.values()], pa.binary())], ["doc_id", "text_hash", "drops"])

    said = lines.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(decide, "doc_id long, text_hash long, drops binary")
    return said.dropDuplicates(["doc_id", "text_hash"])       # rows of equal id and text lose the same lines


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_lines, n_dropped, kept (text): one row per input row.

    Keys of at least ``least_chars`` code points in at least ``least_docs`` documents lose all their lines but
    those in the document of the largest id. A null or empty text is one empty line. Rows of one doc_id are one
    document (rows without an id together another one, smaller than all others), each row keeping its own text;
    ties cannot occur, as only the largest id counts; an empty table gives no rows; other columns are left behind.
    """
    if least_docs < 2:
        raise ValueError("a line of one document repeats in no other")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    plain = columns(docs, doc_id="long", text="string").select("doc_id", F.xxhash64(data).alias("text_hash"), data.alias("text"))
    lines = cut_lineage(line_table(plain, least_chars))
    counts = cut_lineage(line_counts(lines))
    n_shards = max(1, -(-counts.count() // shard_keys))
    answers = probe_shards(lines, hash_shards(counts, n_shards), n_shards, least_docs)
    drops = lines_to_drop(lines, answers).withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    joined = plain.join(drops, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drop in zip(batch.column("text"), batch.column("drops").to_pylist()):
                text = text.as_py()
                n_lines.append(text.count(b"\n") + 1)
                if drop is None:
                    n_dropped.append(0)
                    kept.append(text)
                    continue
                gone = {drop[i:i + 16] for i in range(0, len(drop), 16)}
                stay = [line for line, key in zip(text.split(b"\n"), line_keys(text))
                        if not long_enough(key, least_chars) or line_hash(key) not in gone]
                n_dropped.append(n_lines[-1] - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                                              pa.array(kept, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept"])

    out = joined.select("doc_id", "text", "drops").mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))
