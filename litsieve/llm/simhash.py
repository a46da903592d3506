"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``RADIUS`` = 3 bits differ in at least one of three blocks of bits; with that
block left out they differ in at most two bits, so both lie within one bit (half the radius) of a common
word. Every distinct fingerprint therefore emits, for each left-out block, all variants within one bit of
the rest (132 in all). Variants are shuffled, colliding fingerprints are verified on all 64 bits, and each
pair is reported by one canonical variant only.

A variant shared by more than ``BUCKET`` fingerprints is not paired up. Its members take the full-width
form instead: variants of the 64-bit word within one bit (tag 0) and within two bits of one half (tag 1).
All members of a variant are within 3 bits of any member with tag 0, so they are linked to the smallest of
those; of three differing bits two lie in one half, so no link is lost. The work is linear in the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsieve.llm.common import columns, components, cut_lineage, salted_left_join, shuffle_width, tie_break

SHINGLE = 3
RADIUS = 3
BUCKET = 64
BLOCKS = ((0, 22), (22, 43), (43, 64))
FULL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_DROP = [sum(1 << i for i in range(lo, hi)) for lo, hi in BLOCKS]
_TAG = [(k + 1) << lo for k, (lo, _) in enumerate(BLOCKS)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of the whole text; 0 without words (or text)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined, n = b" ".join(words), len(words) - shingle + 1
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    first, last = start[:n].tolist(), (start + size)[shingle - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        h = np.array([digest(joined[i:j], 42) for i, j in zip(first[at:at + (1 << 16)], last[at:at + (1 << 16)])], dtype=np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """Adds the fingerprint (as a signed long) to every row."""
    @F.pandas_udf("long")
    def fp(texts):
        return texts.map(lambda t: _signed(fingerprint(t, shingle)))

    return df.withColumn(name, fp(F.col(text_col)))


def _collisions(batches: Iterator[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
    """(key, fp) sorted by both -> verified canonical pairs (a, b), and (a, null) for members of large buckets."""
    held_k, held_f, hot = np.empty(0, np.int64), np.empty(0, np.int64), None

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b], names=["a", "b"])

    def closed(k, f):
        if not len(k):
            return
        start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.concatenate((start, [len(k)])))
        many = np.repeat(size > bucket, size)
        if many.any():
            dense = np.unique(f[many])
            yield out(dense, pa.nulls(len(dense), pa.int64()))
        top = int(size[size <= bucket].max(initial=1))
        for d in range(1, top):
            i = np.flatnonzero((k[d:] == k[:-d]) & ~many[d:])
            if not len(i):
                continue
            key, a, b = (x.view(np.uint64) for x in (k[i], f[i], f[i + d]))
            x = a ^ b
            ok = (np.bitwise_count(x) <= RADIUS) & (x != 0)
            key, a, b, x = key[ok], a[ok], b[ok], x[ok]
            want = np.zeros_like(key)
            undecided = np.ones(len(x), bool)
            for drop, tag in zip(_DROP, _TAG):
                here = undecided & ((x & np.uint64(drop)) != 0)
                undecided &= ~here
                keep = np.uint64(FULL ^ drop)
                rest = x & keep
                low = np.where(np.bitwise_count(rest) == 2, rest & (~rest + np.uint64(1)), np.uint64(0))
                want = np.where(here, ((a & keep) | np.uint64(tag)) ^ low, want)
            good = want == key
            if good.any():
                yield out(a[good].view(np.int64), pa.array(b[good].view(np.int64), pa.int64()))

    for batch in batches:
        k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if hot is not None:  # the bucket that is known to be large goes on
            n = int(np.searchsorted(k != hot, True)) if len(k) else 0
            if n:
                dense = np.unique(f[:n])
                yield out(dense, pa.nulls(len(dense), pa.int64()))
            k, f = k[n:], f[n:]
            if not len(k):
                continue
            hot = None
        k, f = np.concatenate((held_k, k)), np.concatenate((held_f, f))
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))
        yield from closed(k[:cut], f[:cut])
        held_k, held_f = k[cut:], f[cut:]
        if len(held_k) > bucket:
            dense = np.unique(held_f)
            yield out(dense, pa.nulls(len(dense), pa.int64()))
            hot, held_k, held_f = held_k[0], np.empty(0, np.int64), np.empty(0, np.int64)
    yield from closed(held_k, held_f)


def _full_flips() -> tuple[np.ndarray, np.ndarray]:
    one = [0] + [1 << i for i in range(64)]
    two = [(1 << i) | (1 << j) for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]
    return np.array(one + two, dtype=np.uint64), np.array([0] * len(one) + [1] * len(two), dtype=np.int8)


def _full_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips, tags = _full_flips()
    for batch in batches:
        f = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(f), 64):
            part = f[at:at + 64]
            keys = (part.view(np.uint64)[:, None] ^ flips[None, :]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(np.tile(tags, len(part))), pa.array(np.repeat(part, len(flips)))],
                names=["key", "tag", "fp"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tag, fp) sorted -> (smallest fp with tag 0, member) for every key that has one."""
    last_key, last_root = None, None
    for batch in batches:
        k, t, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        if not len(k):
            continue
        first = np.concatenate(([True], k[1:] != k[:-1]))
        start = np.flatnonzero(first)
        root, has = f[start].copy(), t[start] == 0
        if last_key is not None and k[0] == last_key:
            has[0] = last_root is not None
            root[0] = last_root if last_root is not None else 0
        run = np.cumsum(first) - 1
        use = has[run] & (f != root[run])
        if use.any():
            pairs = np.unique(np.stack((root[run][use], f[use]), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        last_key, last_root = k[-1], (root[-1] if has[-1] else None)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fps(fp)`` whose components are those of all pairs within
    three bits: every pair itself, or, in large buckets, a star that connects the same fingerprints."""
    fp = F.col("fp")
    variants = []
    for (lo, hi), drop, tag in zip(BLOCKS, _DROP, _TAG):
        rest = fp.bitwiseAND(F.lit(_signed(FULL ^ drop)))
        variants += [rest.bitwiseXOR(F.lit(_signed(tag ^ flip))) for flip in [0] + [1 << i for i in range(64) if not lo <= i < hi]]
    fps = fps.repartition(shuffle_width(fps))   # few bytes, many rows to come: the emission is spread over all tasks
    emitted = fps.select(F.explode(F.array(*variants)).alias("key"), "fp")
    found = cut_lineage(emitted.repartition(shuffle_width(fps), "key").sortWithinPartitions("key", "fp")
                        .mapInArrow(lambda it: _collisions(it, bucket), "a long, b long"))
    pairs = found.where("b is not null")
    dense = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    stars = (dense.mapInArrow(_full_variants, "key long, tag byte, fp long")
             .repartition(shuffle_width(fps), "key").sortWithinPartitions("key", "tag", "fp")
             .mapInArrow(_stars, "a long, b long"))
    return pairs.unionByName(stars)


def simhash_components(docs: DataFrame, bucket: int = BUCKET, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (signed long), component_id: one row per input row.

    component_id is the smallest doc_id reachable over links of at most three bits; documents without
    words (empty, blank or null text) have fingerprint 0 and link like any other; null doc_ids are kept
    and never smallest (null only where a component has no other id); repeated rows each return a row;
    an empty table returns no rows.
    """
    rows = cut_lineage(with_fingerprint(columns(docs, doc_id="long", text="string"), shingle=shingle).select("doc_id", "fp"))
    return component_ids(rows, bucket)


def component_ids(rows: DataFrame, bucket: int = BUCKET, *more: str) -> DataFrame:
    """rows(doc_id, fp, more...) -> rows with component_id; hot fingerprints are aggregated before any join."""
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    joined = components(links(fps.select("fp"), bucket))
    linked = cut_lineage(joined.join(fps, joined["node"] == fps["fp"]).select("fp", "root", "low"))
    low = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    in_links = linked.join(low, "root").select("fp", "component_id")
    copies = fps.where("n > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("low").alias("component_id"))
    groups = in_links.unionByName(copies)  # every other fingerprint stands alone
    out = salted_left_join(rows, groups.withColumn("_grouped", F.lit(True)), "fp", F.col("doc_id"))
    return out.select("doc_id", "fp", *more, F.when(F.col("_grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs' rows, all columns, one of each component: the one of the smallest doc_id.

    Of rows that repeat its id one stays; a component without any id keeps a row of each fingerprint."""
    key = F.xxhash64(F.col("text").cast("string"))
    rows = with_fingerprint(columns(docs, doc_id="long", text="string")).select("doc_id", "fp", key.alias("key"))
    stays = component_ids(cut_lineage(rows), bucket, "key").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    known = stays.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("key").alias("_key"))
    other = stays.where("doc_id is null").groupBy("fp").agg(F.min("key").alias("_key"))
    stays = known.select("_id", F.lit(False).alias("_null"), "_key").unionByName(
        other.select(F.lit(0).cast("long").alias("_id"), F.lit(True).alias("_null"), "_key"))
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), tie_break(docs).alias("_tie"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
                        F.col("doc_id").isNull().alias("_null"), key.alias("_key"))
    one = Window.partitionBy("_id", "_null", "_key").orderBy("_tie")
    return (keyed.join(stays, ["_id", "_null", "_key"]).withColumn("_row", F.row_number().over(one))
            .where("_row = 1").select("_doc.*"))
