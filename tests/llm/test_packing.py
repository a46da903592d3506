import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from helpers import empty_documents, odd_documents, rows_of
from litsieve.llm import packing
from tokenizers import Tokenizer

TEXTS = ["a  b", " a b", "a b ", "a \n b", "a\n b", "", "  ", " ", "a b\n\nc  d e", "it's a 's x\t y", "é è   x", "a b  c",
         "I'll WE'VE don't 123abc 你好 ... !!", "x\n", "\nx", "<|endoftext|> tail",
         "a<|endoftext|>b", "a <|endoftext|>  <|endoftext|>", "<|endoftext|", "x <|endoftext|><|endoftext|>\n", "tab\there", "a\x1cb c\x85d"]


def test_ids_equal_the_tokenizers_library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(None)
    for text in TEXTS:
        assert encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_tree_finds_the_tightest_bin():
    rng = random.Random(1)
    for capacity in (1, 7, 64, 100, 2048):
        tree, have = packing.CapacityTree(capacity), []
        for step in range(600):
            if rng.random() < 0.5:
                room = rng.randint(1, capacity)
                tree.add(room, step)
                have.append((room, step))
            else:
                need = rng.randint(1, capacity)
                fits = sorted(r for r, _ in have if r >= need)
                got = tree.take_tightest(need)
                assert (got is None) == (not fits)
                if got:
                    assert got[0] == fits[0] and got in have
                    have.remove(got)


def check(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return by


def test_pieces_and_sequences(spark):
    docs = odd_documents(spark)
    rows = rows_of(packing.pack_documents(docs))
    check(rows)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in rows_of(docs.select("doc_id", "text")):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(str, want)) == sorted(str(tuple(r[n] for n in names)) for r in rows)


def test_shards_pack_nearly_as_well_as_one(spark):
    rng = random.Random(5)
    pieces = [(i, 0, 0, min(2048, int(rng.lognormvariate(6, 1))) or 1, i) for i in range(4000)]
    df = spark.createDataFrame(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")
    few = len(check(rows_of(packing.pack(df, shard_pieces=1000))))
    least = -(-sum(p[3] for p in pieces) // 2048)
    assert least <= few <= least * 1.01 + 4


def test_empty_table(spark):
    assert packing.pack_documents(empty_documents(spark)).count() == 0
