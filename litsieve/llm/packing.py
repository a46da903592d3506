"""Best-fit-decreasing packing of token sequences, bins found by a segment tree over capacities."""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.llm.common import columns, cut_lineage

CAPACITY = 2048
SEPARATOR = 0
SHARD_PIECES = 200_000     # pieces that one task packs; a shard ends with a few bins that are not full
TOKENIZER = "byte_bpe_50k.tiktoken"   # the vocabulary of byte_bpe_50k.json as ranks; ids are the same
ADDED = "byte_bpe_50k.json"           # names the added tokens, whose strings take their own ids wherever a text holds them
BESIDE = re.compile(r"\s\s")
#: The tokenizer's cuts where no two white-space characters meet; without its look-ahead it runs about twice as fast.
LONE_SPACES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


class Encoder:
    """Token ids of whole texts as little-endian 32-bit integers; an added token's string takes that token's id."""

    def __init__(self, path: str, added: str):
        import base64
        import json

        import public_tokenizers
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.any = tiktoken.Encoding("any", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(added, encoding="utf-8") as tokenizer:
            self.added = {t["content"]: int(t["id"]) for t in json.load(tokenizer)["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.lone = tiktoken.Encoding("lone", pat_str=LONE_SPACES, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        return b"".join(self.added[part].to_bytes(4, "little") if part in self.added else self.plain(part) for part in self.cut.split(text))

    def plain(self, text: str) -> bytes:
        encoding = self.any if BESIDE.search(text) else self.lone
        return array("I", encoding.encode_ordinary(text)).tobytes()


@functools.lru_cache(maxsize=1)
def encoder(path: str | None) -> Encoder:
    import public_tokenizers
    return Encoder(path or public_tokenizers.path(TOKENIZER), public_tokenizers.path(ADDED))


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: one piece, or full ones after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _tokenize(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = encode(text or "") + SEPARATOR.to_bytes(4, "little")
            for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids followed by the separator id."""
    return columns(docs, doc_id="long", text="string").mapInArrow(
        lambda it: _tokenize(it, path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf holds the open bins with that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)      # open bins below each node
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        at = self.size + room
        while at:
            self.open[at] += 1
            at >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Removes an open bin with the least room that is still >= need: (room, bin)."""
        count, at = self.open, self.size + need
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up to the first node with something to its right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:                            # down to its leftmost open leaf
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item; ``lengths`` must descend."""
    tree, bins, offsets, made = CapacityTree(capacity), [], [], 0
    for need in lengths:
        found = tree.take_tightest(need) if need < capacity else None
        if found is None:
            room, b = capacity, made
            made += 1
        else:
            room, b = found
        bins.append(b)
        offsets.append(capacity - room)
        if room > need:
            tree.add(room - need, b)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, piece, start, length, ids_crc32).

    Pieces are dealt to shards of about ``shard_pieces`` by their place in the checkpointed input, whatever
    their key; each shard is packed by one task. Full pieces fill a sequence each and need no packing.
    """
    rows = cut_lineage(pieces.withColumn("_at", F.monotonically_increasing_id()))
    shards = max(1, -(-rows.count() // shard_pieces))
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64("_at"), F.lit(shards)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def one(table: pa.Table) -> pa.Table:
        shard = table.column("_shard")[0].as_py() if len(table) else 0
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("_at", "ascending")])
        bins, offsets = best_fit_decreasing(table.column("length").to_pylist(), capacity)
        ids = pa.array(np.array(bins, dtype=np.int64) * shards + shard, pa.int64())
        return pa.table([table.column(n) for n in names] + [ids, pa.array(offsets, pa.int64())], names=names + ["sequence_id", "offset"])

    return dealt.select(*names, "_at", "_shard").groupBy("_shard").applyInArrow(
        one, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> one row per piece with its sequence and offset.

    A null or empty text is the separator alone (length 1); repeated rows and null doc_ids are packed like
    any row; ties go by doc_id, piece and place; an empty table gives no rows. The string of an
    added token (the end-of-text mark) takes that token's id, as in the tokenizer's own library. Only documents longer than ``capacity`` are cut.
    """
    return pack(tokenized_pieces(docs, capacity, path), capacity)
