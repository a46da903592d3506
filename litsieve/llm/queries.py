"""Registered queries of the training-data operators, each over its whole table, and their oracle SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm import convtrie, extract, langid, lblm, linededup, mixing, packing, periodic, rarefeatures, sharding, simhash, topk, warc
from litsieve.session import read_table


def op1_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("vec_id"), topk.scaled(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(read_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(read_table(spark, sf_dir, "pages"))


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lblm.score_documents(read_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixture(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "shards")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(read_table(spark, sf_dir, "documents"))


def op10_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rarefeatures.fingerprints(read_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.conversation_trie(read_table(spark, sf_dir, "conversations"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def repeat_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In a tenth of the documents, the words from a place on repeat with a period; both come from the id's checksum."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(read_table(spark, sf_dir, "documents"), repeat_words)
    # the longest run, ties to the smallest start, then period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
                         F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
                        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_maxscore_topk, op2_warc_index_merge, op3_simhash, op4_best_fit_packing, op5_page_differencing, op6_log_bilinear,
    op7_mixing, op8_sharding, op9_language_id, op10_improbable_features, op11_conversation_trie, op12_line_dedup,
    op13_periodic_runs, pipeline)}

ORACLE = {
    "op1_maxscore_topk": """
        WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS u FROM embeddings
                   WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                     CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.u, c.u)]) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op2_warc_index_merge": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_id THEN first_id END AS refers_to FROM f""",
    "op11_conversation_trie": """
        WITH ids AS (SELECT conv_id, ascii_bytes FROM (SELECT DISTINCT conv_id, [ascii(x) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')] AS ascii_bytes
                     FROM conversations WHERE conv_id IS NOT NULL) i),
        c AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295], ascii_bytes), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
                     lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 AS h, conv_id - conv_id % 5 AS leader FROM ids),
        o AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS ts
              FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        b AS (SELECT c.conv_id, list_concat(coalesce(l.ts[1:c.h], []), o.ts[c.h + 1:]) AS ts FROM c JOIN o USING (conv_id) LEFT JOIN o l ON l.conv_id = c.leader),
        k AS (SELECT conv_id, len(ts) AS n, [sha256(CAST(strlen(x.r) AS VARCHAR) || ':' || x.r || x.t) FOR x IN ts] AS ks, [strlen(x.t) FOR x IN ts] AS bs FROM b),
        p AS (SELECT conv_id, n, d, array_to_string(ks[1:d], '') AS key, array_to_string(ks[1:d - 1], '') AS up, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS bytes
              FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM k) u),
        v AS (SELECT d, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
                     coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM p GROUP BY d, key),
        w AS (SELECT v.*, u.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children FROM v
              LEFT JOIN v u ON u.d = v.d - 1 AND u.key = v.up
              LEFT JOIN (SELECT d - 1 AS d, up, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1, 2) k ON k.d = v.d AND k.up = v.key),
        a AS (SELECT unnest(range(0, d + 1)) AS d, key, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * bytes AS saved FROM w),
        s AS (SELECT d, substr(key, 1, 64 * d) AS key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY 1, 2)
        SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM w JOIN s ON s.d = w.d AND s.key = w.key""",
    "op12_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        k AS (SELECT doc_id, ls, [translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FOR x IN ls] AS ks FROM d),
        u AS (SELECT DISTINCT doc_id, unnest(ks) AS key FROM k),
        c AS (SELECT key, max(doc_id) AS keeper FROM u WHERE length(key) >= 20 GROUP BY key HAVING count(*) >= 3),
        x AS (SELECT doc_id, list(key) AS drops FROM u JOIN c USING (key) WHERE doc_id IS DISTINCT FROM keeper GROUP BY doc_id),
        r AS (SELECT k.doc_id, ls, [ls[i] FOR i IN range(1, len(ls) + 1) IF NOT coalesce(list_contains(drops, ks[i]), false)] AS kept
              FROM k LEFT JOIN x ON x.doc_id IS NOT DISTINCT FROM k.doc_id)
        SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped,
               sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM r""",
}
