"""Exact top-k inner-product search by MaxScore over shards of impact postings.

Candidates are dealt to shards, queries to blocks; a (shard, block) cell is searched by one task, and the
cells' lists are merged per query. In a cell a dimension is a term and its postings are the candidates'
components above the shard's smallest (for a negative query component: below the largest), so that all
contributions are non-negative and a term's score bound is |q| times its range. Terms are ordered by bound;
the trailing ones whose bounds cannot lift a candidate past the query's threshold are non-essential.
Essential postings are traversed for all candidates of a run at once; the others are probed only for
candidates that are still competitive, in two steps, or in one matrix product where they are many. Everything is integer arithmetic held in doubles
while sums stay below 2^53 (else in 64-bit integers), so scores are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
SHARD_ROWS = 4_096       # candidates of a cell
BLOCK_ROWS = 4_096       # queries of a cell
RUN_ROWS, RUN_QUERIES = 1_024, 512
PROBE_SHARE = 64         # above one in so many still competitive, probing is one matrix product
SCALE = 64


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list<long> column, shorter ones filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def _width(column: pa.ChunkedArray) -> int:
    import pyarrow.compute as pc
    return pc.max(pc.list_value_length(column)).as_py() or 0


def maxscore(ids: np.ndarray, docs: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query_id, id, score) arrays of the k best candidates of each query, itself left out; ties to smaller ids.
    ``ids`` must ascend."""
    top = [max((abs(int(m.max())), abs(int(m.min()))), default=0) if m.size else 0 for m in (docs, queries)]
    kind = np.float64 if (top[0] + 1) * (top[1] + 1) * max(1, docs.shape[1]) * 4 < 2 ** 53 else np.int64
    docs, queries = docs.astype(kind), queries.astype(kind)
    low, high = docs.min(axis=0), docs.max(axis=0)
    up = docs - low                                    # postings of positive query components
    found = ([], [], [])
    for b in range(0, len(queries), RUN_QUERIES):
        q, own = queries[b:b + RUN_QUERIES], query_ids[b:b + RUN_QUERIES]
        # score = base + sum of non-negative contributions; a negative component reads high - component
        base = np.where(q > 0, q * low, q * high).sum(axis=1)
        shift = np.where(q > 0, 0, -q * (high - low)).sum(axis=1)   # turns q*up into the contribution, summed
        bound = np.abs(q) * (high - low)
        order = np.argsort(bound, axis=1, kind="stable")             # weakest terms first
        weakest = np.take_along_axis(bound, order, axis=1)
        reach = np.cumsum(weakest, axis=1)
        best_q, best_i, best_s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind)
        threshold = np.full(len(q), -np.inf)
        for r in range(0, len(ids), RUN_ROWS):
            some, post = ids[r:r + RUN_ROWS], up[r:r + RUN_ROWS]
            skip = (base[:, None] + reach <= threshold[:, None]).sum(axis=1)  # non-essential terms of each query
            essential = np.ones_like(q, dtype=bool)
            np.put_along_axis(essential, order, np.arange(q.shape[1])[None, :] >= skip[:, None], axis=1)
            spare = np.where(skip > 0, np.take_along_axis(reach, np.maximum(skip - 1, 0)[:, None], axis=1)[:, 0] if q.shape[1] else 0, 0)
            lift = base + np.where(essential & (q < 0), bound, 0).sum(axis=1)
            part = (q * essential) @ post.T + lift[:, None]
            if r == 0 and part.shape[1] > k:          # a first threshold from this run alone
                seen = np.where(own[:, None] == some[None, :], -np.inf, part)
                threshold = np.partition(seen, -k, axis=1)[:, -k] - 0.5
            other = own[:, None] != some[None, :]
            live = (part + spare[:, None] > threshold[:, None]) & other
            many = np.count_nonzero(live) * PROBE_SHARE > live.size and skip.any()
            if many:                                  # probed as one matrix product
                part += (q * ~essential) @ post.T + np.where(~essential & (q < 0), bound, 0).sum(axis=1)[:, None]
                live = (part > threshold[:, None]) & other
            qi, di = np.nonzero(live)
            score = part[qi, di]
            for step in (0, 1):                       # probe the stronger half of the rest, then the others
                if many or not skip.any() or not len(qi):
                    break
                half = skip // 2
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(q.shape[1])[None, :], axis=1)
                now = (rank < skip[:, None]) & ((rank >= half[:, None]) if step == 0 else (rank < half[:, None]))
                weight = np.where(now, q, 0)
                score = score + np.where(now & (q < 0), bound, 0).sum(axis=1)[qi]
                for at in range(0, len(qi), 1 << 15):
                    part_q, part_d = qi[at:at + (1 << 15)], di[at:at + (1 << 15)]
                    score[at:at + (1 << 15)] += np.einsum("ij,ij->i", weight[part_q], post[part_d])
                left = np.where(half > 0, np.take_along_axis(reach, np.maximum(half - 1, 0)[:, None], axis=1)[:, 0], 0) if step == 0 else np.zeros(len(q))
                keep = score + left[qi] > threshold[qi]
                qi, di, score = qi[keep], di[keep], score[keep]
            best_q, best_i, best_s = (np.concatenate(x) for x in ((best_q, qi), (best_i, some[di]), (best_s, score)))
            by = np.lexsort((best_i, -best_s, best_q))
            best_q, best_i, best_s = best_q[by], best_i[by], best_s[by]
            first = np.searchsorted(best_q, np.arange(len(q)))
            place = np.arange(len(best_q)) - first[best_q]
            best_q, best_i, best_s, place = (x[place < k] for x in (best_q, best_i, best_s, place))
            full = best_q[place == k - 1]
            threshold[full] = best_s[place == k - 1]
        for to, x in zip(found, (own[best_q], best_i, best_s.astype(np.int64))):
            to.append(x)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in found)


def _cell(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    names = ["query_id", "vec_id", "score"]
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], pa.int64())] * 3, names=names)
    left = left.sort_by("vec_id")
    width = max(_width(left["vector"]), _width(right["vector"]))
    got = maxscore(left["vec_id"].to_numpy(), _matrix(left["vector"], width), right["vec_id"].to_numpy(), _matrix(right["vector"], width), k)
    return pa.table([pa.array(x, pa.int64()) for x in got], names=names)


def scaled(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null for null vectors and for those that hold null or non-finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    wide = F.transform(embedding, lambda x: x.cast("double"))
    return F.when(embedding.isNotNull() & ~F.exists(wide, odd), F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """vectors(vec_id, vector), queries(vec_id, vector) of longs -> query_id, rank, vec_id, score.

    Null vectors and null ids take no part; missing components count as 0, so an empty vector scores 0;
    a query never meets the candidate of its own id; of rows that share an id the smallest vector stands,
    so repeated rows count once; ties go to the smaller vec_id; an empty table gives no rows. Scores must
    fit in 64 bits.
    """
    def unique(df):
        return df.where("vec_id is not null and vector is not null").groupBy("vec_id").agg(F.min("vector").alias("vector"))

    vectors, queries = unique(vectors), unique(queries)
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))

    def cells(df, own, of_own, other, of_other):
        """Rows with their own shard (or block), repeated for every block (or shard)."""
        return df.select("vec_id", "vector", F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(of_own)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(of_other - 1))).alias(other)).select("shard", "block", "vec_id", "vector")

    left, right = cells(vectors, "shard", shards, "block", blocks), cells(queries, "block", blocks, "shard", shards)
    found = (left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
             .applyInArrow(lambda a, b: _cell(a, b, k), "query_id long, vec_id long, score long"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
