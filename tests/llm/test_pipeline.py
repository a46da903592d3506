"""The pipeline against plain Python, stage by stage, each on its predecessor's written table."""
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from helpers import odd_documents, rows_of
from litsieve.llm import simhash
from litsieve.session import read_table
from test_mixing import plain_targets
from test_packing import check
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_of_the_pipeline(spark, tmp_path):
    docs = read_table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs_in, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == docs_in.columns
        kept[name] = rows_of(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "mixing", "packing"]
    given = rows_of(read_table(spark, SF, "documents"))
    assert len(kept["language"]) >= 0.98 * len(given)

    told = sorted(kept["language"], key=lambda d: d["doc_id"])
    groups = plain_components([plain_fingerprint(d["text"]) for d in told])
    assert sorted(d["doc_id"] for d in kept["near_dedup"]) == [told[i]["doc_id"] for i in sorted(set(groups))]

    words = {d["doc_id"]: len(d["text"].encode().split()) for d in told}
    size, taken = Counter(), Counter()
    for d in kept["near_dedup"]:
        size[d["source"]] += words[d["doc_id"]]
    for d in kept["mixing"]:
        taken[d["source"]] += words[d["doc_id"]]
    assert max(Counter(d["doc_id"] for d in kept["mixing"]).values()) <= 3
    for source, target in plain_targets(dict(size)).items():
        assert abs(taken[source] - target) <= 0.1 * target, source

    check(kept["packing"])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d in kept["mixing"]:
        want[d["doc_id"]] += len(t.encode(d["text"], add_special_tokens=False).ids) + 1
    have = Counter()
    for r in kept["packing"]:
        have[r["doc_id"]] += r["length"]
    assert have == want


def test_stages_take_odd_documents(spark):
    docs = odd_documents(spark, "size long, shard int, score string, _row int").drop("n_chars")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert docs.columns == out.columns, name
        assert {(r["size"], r["shard"], r["score"], r["_row"]) for r in rows_of(out)} == {(7, 7, "7", 7)}, name
        assert stage(spark, docs.where("doc_id < 0"), SF).count() == 0
        assert out.count() > 0


def test_words_and_bytes_agree():
    assert simhash.fingerprint("A  b\tC") == plain_fingerprint("a b c") and np.uint64(0) == 0
