"""Pair scorers and signatures as column expressions.

Scores are on a 0-100 scale like the reference's matcher. The edit-distance scorer is
``ratio = 100 * (1 - levenshtein / max(len))``; an empty key matches nothing.
"""

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from litsieve.functions.columns import col_of

EPS = 1e-9

WORDS_AT_A_TIME = 1 << 16  # of a batch's rows, in numpy


def max_edits(length: Column, threshold: float) -> Column:
    """Largest edit count that still reaches ``threshold`` (0-100) at this max length."""
    return F.floor((F.lit(100.0) - F.lit(float(threshold))) * length / F.lit(100.0) + F.lit(EPS)).cast("int")


def ratio(a, b) -> Column:
    """Unbounded edit-distance ratio 0-100 (0 when both are empty)."""
    a, b = col_of(a), col_of(b)
    lmax = F.greatest(F.length(a), F.length(b))
    return F.when(lmax == 0, F.lit(0.0)).otherwise(F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / lmax))


def bounded_ratio(a, b, threshold: float) -> Column:
    """D13 with the cut-off handed to the distance: NULL when below ``threshold``.

    ``levenshtein(a, b, k)`` stops at k and returns -1, so non-matching pairs are cheap.
    """
    a, b = col_of(a), col_of(b)
    lmax = F.greatest(F.length(a), F.length(b))
    k = max_edits(lmax, threshold)
    d = F.call_function("levenshtein", a, b, k)
    score = F.lit(100.0) * (F.lit(1.0) - d / lmax)
    return F.when((lmax > 0) & (d >= 0) & (score >= F.lit(float(threshold)) - F.lit(EPS)), score)


def sorted_tokens(c) -> Column:
    """Whitespace words sorted and re-joined with one blank (token_sort preprocessing)."""
    words = F.filter(F.split(col_of(c), r"\s+"), lambda x: x != F.lit(""))
    return F.array_join(F.array_sort(words), " ")


def let(value, body) -> Column:
    """``body`` over ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _ratio_from(a, b, threshold: float | None) -> Column:
    return ratio(a, b) if threshold is None else bounded_ratio(a, b, threshold)


def token_sort_ratio(a, b, threshold: float | None = None) -> Column:
    """Ratio of the sorted words; NULL below ``threshold`` where one is given."""
    return let(F.struct(sorted_tokens(a).alias("a"), sorted_tokens(b).alias("b")),
               lambda s: _ratio_from(s["a"], s["b"], threshold))


def _words(c) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(col_of(c), r"\s+"), lambda x: x != F.lit(""))))


def token_set_ratio(a, b, threshold: float | None = None) -> Column:
    """t0 = sorted common words, t1 = t0 + rest(a), t2 = t0 + rest(b);
    max(ratio(t0,t1), ratio(t0,t2), ratio(t1,t2)); 100 when t0 is non-empty and a side has no rest.
    NULL below ``threshold`` where one is given: the distances then stop early."""
    def split_words(w):
        return F.struct(F.array_intersect(w["a"], w["b"]).alias("common"), F.array_except(w["a"], w["b"]).alias("ra"),
                        F.array_except(w["b"], w["a"]).alias("rb"))

    def texts(s):
        t0 = F.array_join(s["common"], " ")
        return F.struct(t0.alias("t0"), F.trim(F.concat_ws(" ", t0, F.array_join(s["ra"], " "))).alias("t1"),
                        F.trim(F.concat_ws(" ", t0, F.array_join(s["rb"], " "))).alias("t2"))

    pairs = (("t0", "t1"), ("t0", "t2"), ("t1", "t2"))

    def score(s):
        full = (F.size(s["common"]) > 0) & ((F.size(s["ra"]) == 0) | (F.size(s["rb"]) == 0))
        best = let(texts(s), lambda t: F.greatest(*[_ratio_from(t[x], t[y], threshold) for x, y in pairs]))
        return F.when(full, F.lit(100.0)).otherwise(best)

    return let(F.struct(_words(a).alias("a"), _words(b).alias("b")), lambda w: let(split_words(w), score))


def composite_score(a, b, threshold: float | None = None) -> Column:
    """WRatio-like blend used as the reference's default scorer intent:
    greatest(ratio, 0.95 * token_sort, 0.95 * token_set); NULL below ``threshold`` where one is given."""
    token = None if threshold is None else threshold / 0.95
    return F.greatest(_ratio_from(a, b, threshold), F.lit(0.95) * token_sort_ratio(a, b, token),
                      F.lit(0.95) * token_set_ratio(a, b, token))


def words_of(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each word, start of each row and the end of the last, the numbered words) of a batch's word lists."""
    lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    encoded = rows.flatten().dictionary_encode()
    return encoded.indices.to_numpy(), np.r_[0, np.cumsum(lengths)], encoded.dictionary


def row_chunks(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` words together, one row at least."""
    low, n = 0, len(starts) - 1
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(starts, starts[low] + most, side="right")) - 1))
        yield low, high
        low = high


def _distances(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, term: str) -> np.ndarray:
    """Edit distance of every word to ``term``; words by falling length, so that those still read come first."""
    letters = np.frombuffer(term.encode("utf-32-le"), dtype=np.uint32)
    row = [np.full(len(lengths), j, dtype=np.int32) for j in range(len(letters) + 1)]
    for i in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -i, side="left"))      # longer than i
        at, above = codes[starts[:n] + i], row[0][:n].copy()
        row[0][:n] = i + 1
        for j, letter in enumerate(letters, 1):
            old = row[j][:n].copy()
            row[j][:n] = np.minimum(np.minimum(old, row[j - 1][:n]) + 1, above + (at != letter))
            above = old
    return row[-1]


def best_word_similarity(words, terms: list[str]) -> Column:
    """For each term the highest 1 - levenshtein / max(len) over the row's words, 0 without any (empty words do not
    count): one array a row. A word is compared once for all rows of a batch that hold it."""
    @F.arrow_udf("array<double>")
    def best(rows: pa.Array) -> pa.Array:
        numbers, starts, known = words_of(rows)
        lengths = pc.utf8_length(known).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        codes = np.frombuffer("".join(known.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
        begins = (np.cumsum(lengths) - lengths)[order]
        table = np.zeros((len(known), len(terms)))
        for j, term in enumerate(terms):
            longest = np.maximum(lengths[order], len(term))
            distance = _distances(codes, begins, lengths[order], term)
            table[order, j] = np.where(lengths[order] > 0, 1.0 - distance / np.maximum(longest, 1), 0.0)
        out = np.zeros((len(rows), len(terms)))
        for low, high in row_chunks(starts, WORDS_AT_A_TIME):
            full = np.flatnonzero(np.diff(starts[low:high + 1]) > 0)
            if len(full):
                out[low + full] = np.maximum.reduceat(table[numbers[starts[low]:starts[high]]], starts[low + full] - starts[low], axis=0)
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(terms))
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

    return best(words)


def jaccard(wa, wb) -> Column:
    """|A ∩ B| / |A ∪ B| of two distinct-word arrays; 0 for two empty sets."""
    wa, wb = col_of(wa), col_of(wb)
    inter = F.size(F.array_intersect(wa, wb))
    union = F.size(wa) + F.size(wb) - inter
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


def cosine(a, b) -> Column:
    """V2: cosine similarity of two equal-length float arrays (as double)."""
    a = F.transform(col_of(a), lambda x: x.cast("double"))
    b = F.transform(col_of(b), lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, v: acc + v * v))
    return F.when((na == 0) | (nb == 0), F.lit(None).cast("double")).otherwise(dot / (na * nb))


# ---- MinHash (D9) ----------------------------------------------------------------------------

MERSENNE = 2147483647  # 2^31 - 1


def word_hash(w: Column) -> Column:
    """28-bit integer from the word's md5 (reproducible in any SQL engine)."""
    return F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint")


def permutations(num_perm: int = 128, seed: int = 1) -> list[tuple[int, int]]:
    """(a, b) coefficients of ``num_perm`` universal hash functions, from a fixed rule."""
    out = []
    x = seed
    for _ in range(num_perm):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        a = 1 + (x >> 33) % (MERSENNE - 1)
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        b = (x >> 33) % MERSENNE
        out.append((int(a), int(b)))
    return out


def minhash_signature(words: Column, num_perm: int = 128, seed: int = 1) -> Column:
    """Array of ``num_perm`` minima of (h(w) * a + b) mod (2^31 - 1) over the word set (NULL for an empty one).

    Runs in numpy on Arrow batches: a word is hashed and multiplied once for all sets of a batch that hold it.
    28-bit hash times a 31-bit coefficient stays inside a 64-bit integer.
    """
    return _minhash_udf(num_perm, seed)(words)


def minhash_signature_expr(words: Column, num_perm: int = 128, seed: int = 1) -> Column:
    """Same signature as pure Spark expressions (slower: higher-order functions are interpreted)."""
    hashes = F.transform(words, word_hash)
    perms = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"))
                      for a, b in permutations(num_perm, seed)])
    return F.transform(perms, lambda p: F.array_min(F.transform(hashes, lambda h: (h * p["a"] + p["b"]) % MERSENNE)))


_UDFS: dict = {}


def _minhash_udf(num_perm: int, seed: int):
    key = (num_perm, seed)
    if key in _UDFS:
        return _UDFS[key]
    coeff = np.array(permutations(num_perm, seed), dtype=np.uint64)
    a, b, modulus = coeff[:, 0], coeff[:, 1], np.uint64(MERSENNE)

    def permuted(h: np.ndarray) -> np.ndarray:
        x = h[:, None] * a + b
        x = ((x & modulus) + (x >> np.uint64(31))).astype(np.uint32)   # 2^31 is 1 there
        return np.minimum(x, x - np.uint32(MERSENNE))

    @F.arrow_udf("array<bigint>")
    def minhash(words: pa.Array) -> pa.Array:
        codes, starts, known = words_of(words)
        h = np.array([int(md5(w.encode()).hexdigest()[:7], 16) for w in known.to_pylist()], dtype=np.uint64)
        out = [np.zeros((0, num_perm), dtype=np.uint32)]
        for low, high in row_chunks(starts, WORDS_AT_A_TIME):
            here, at = np.unique(codes[starts[low]:starts[high]], return_inverse=True)
            full = starts[low:high][np.diff(starts[low:high + 1]) > 0] - starts[low]
            if len(full):
                out.append(np.minimum.reduceat(permuted(h[here])[at], full, axis=0))
        empty = np.diff(starts) == 0
        ends = np.r_[0, np.cumsum(np.where(empty, 0, num_perm))].astype(np.int32)
        flat = pa.array(np.concatenate(out).ravel().astype(np.int64))
        return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(empty))

    _UDFS[key] = minhash
    return minhash
