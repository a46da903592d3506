"""Keyword and phrase categorisation.

Lexicons are small user input, so each is compiled into literal column expressions: one
projection, no shuffle and no join, whatever the number of terms. ``phrase_labels_join`` is a
separate operator for lexicons that come as large tables: an equi-join of word n-grams against
the exploded lexicon, still without a cross join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.constants import DEFAULT_MIN_SCORE, LABEL_SEPARATOR, PAIR_SEPARATOR, UNCATEGORIZED, UNKNOWN
from litsieve.functions.columns import once, string_columns
from litsieve.functions.lexicon import Lexicon
from litsieve.functions.similarity import best_word_similarity
from litsieve.functions.text import alternation, search_text


def _with_hits(df: DataFrame, text_cols, *lexicons: Lexicon) -> tuple[DataFrame, Callable[[str], Column]]:
    """``df`` with columns __search (the lower-cased text between blanks) and __hit, one flag a variant of the lexicons:
    each is looked up once a row, however many expressions ask for it by the second result."""
    variants = sorted({v.lower() for lexicon in lexicons for _, vs in lexicon.entries for v in vs})
    text = once(df, "__search", F.concat(F.lit(" "), search_text(text_cols, lower=True), F.lit(" ")))
    flags = [F.contains(F.col("__search"), F.lit(f" {v} ")) for v in variants]
    found = once(text, "__hit", F.array(*flags) if flags else F.array().cast("array<boolean>"))
    return found, lambda v: F.get("__hit", F.lit(variants.index(v.lower())))


def _any(conds: list[Column]) -> Column:
    """OR of the conditions as a balanced tree, so its depth stays small for any number of them."""
    while len(conds) > 1:
        conds = [conds[i] | conds[i + 1] if i + 1 < len(conds) else conds[i] for i in range(0, len(conds), 2)]
    return conds[0] if conds else F.lit(False)


def _phrase_hits(hit: Callable[[str], Column], lexicon: Lexicon) -> Column:
    """Array of the categories with a whole-phrase hit, lexicon order."""
    whens = [F.when(_any([hit(v) for v in vs]), F.lit(cat)) for cat, vs in lexicon.entries if vs]
    if not whens:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*whens))


def phrase_labels(df: DataFrame, text_cols, core: Lexicon, additional: Lexicon | None = None,
                  out_col: str = "primary_category") -> DataFrame:
    """Whole-phrase multi-label tags, sorted and ', '-joined; no hit -> 'Uncategorized'.

    Blank-delimited only: punctuation is not removed and newlines are not blanks.
    """
    lex = core.merged(additional) if additional else core
    found, hit = _with_hits(df, text_cols, lex)
    hits = F.array_sort(_phrase_hits(hit, lex))
    label = F.when(F.size(hits) > 0, F.array_join(hits, LABEL_SEPARATOR)).otherwise(F.lit(UNCATEGORIZED))
    return once(found, out_col, label).drop("__search", "__hit")


def phrase_labels_join(df: DataFrame, text_cols, lexicon: Lexicon, out_col: str = "primary_category",
                       id_col: str = "paper_id") -> DataFrame:
    """C1 over large lexicons, as an operator of its own: blank-split n-grams of the text joined to the exploded lexicon.

    The lexicon side is built on the driver from a lexicon we hold in memory, so its size is
    known before it is broadcast; the text side is never replicated.
    """
    spark = df.sparkSession
    rows = [(cat, v.lower(), len(v.lower().split(" "))) for cat, vs in lexicon.entries for v in vs]
    lex_df = spark.createDataFrame(rows, "category string, phrase string, n_words int")
    lengths = sorted({r[2] for r in rows})
    words = df.select(id_col, F.split(search_text(text_cols, lower=True), " ").alias("__w"))
    grams = words.select(
        id_col, F.explode(F.array(*[_ngrams(F.col("__w"), n) for n in lengths])).alias("__g"),
    ).select(id_col, F.explode("__g").alias("phrase"))
    # the lexicon frame's size is known here; up to 100k phrases it is broadcast and the n-grams
    # are matched map-side, so only the hits are shuffled (grouped per paper)
    small = F.broadcast(lex_df) if len(rows) <= 100_000 else lex_df
    hits = grams.join(small, "phrase").groupBy(id_col).agg(
        F.array_join(F.array_sort(F.collect_set("category")), LABEL_SEPARATOR).alias(out_col))
    return df.join(hits, id_col, "left").withColumn(out_col, F.coalesce(F.col(out_col), F.lit(UNCATEGORIZED)))


def _ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` consecutive blank-split words, re-joined with single blanks."""
    def gram(i):
        return F.array_join(F.slice(words, i + 1, n), " ")
    starts = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(starts, gram)).otherwise(F.array().cast("array<string>"))


def _variant_hits(hit: Callable[[str], Column], variants) -> Column:
    return F.array_compact(F.array(*[F.when(hit(v), F.lit(v)) for v in variants]))


def _variant_score(hit: Column, similarity: Column | None) -> Column:
    """1 for a whole-phrase hit; a miss scores ``similarity``, the best one to a word of the text, where it is given
    (single-word variants only)."""
    whole = F.when(hit, F.lit(1.0))
    return F.coalesce(whole, F.lit(0.0)) if similarity is None else F.coalesce(whole, similarity, F.lit(0.0))


def scored_keywords(df: DataFrame, text_cols, lexicon: Lexicon, min_score: float = DEFAULT_MIN_SCORE,
                    strategy: str = "best", out_col: str = "primary_category", fuzzy: bool = False) -> DataFrame:
    """Score of a category = mean over its variants of the variant score (whole-phrase hit
    = 1, else 0; with ``fuzzy=True`` a miss scores the best word-level edit similarity), i.e.
    the share of variants found when not fuzzy.

    strategy 'best': highest score, earliest category on ties; 'first': first category in
    lexicon order whose score reaches ``min_score``. Below ``min_score`` -> 'Uncategorized',
    score 0 and no keywords. Emits ``match_score`` and ``matched_keywords`` (lexicon order).
    """
    if strategy not in ("best", "first"):
        raise ValueError("strategy must be 'best' or 'first'")
    out, hit = _with_hits(df, text_cols, lexicon)
    cands = []
    if fuzzy:
        single = sorted({v.lower() for _, vs in lexicon.entries for v in vs if " " not in v.strip()})
        out = out.withColumn("__near", best_word_similarity(F.split("__search", " "), single))
    for pos, (cat, vs) in enumerate(lexicon.entries):
        if not vs:
            continue
        hits = _variant_hits(hit, vs)
        if fuzzy:
            total = None
            for v in vs:
                sv = _variant_score(hit(v), None if " " in v.strip() else F.get("__near", F.lit(single.index(v.lower()))))
                total = sv if total is None else total + sv
            score = total / F.lit(float(len(vs)))
        else:
            score = F.size(hits).cast("double") / F.lit(float(len(vs)))
        cands.append(F.struct(score.alias("score"), F.lit(-pos).alias("neg_pos"), F.lit(cat).alias("category"),
                              hits.alias("hits")))
    out = once(out, "__arr", F.filter(F.array(*cands), lambda s: s["score"] >= F.lit(min_score)))
    arr = F.col("__arr")
    if strategy == "best":
        chosen = F.element_at(F.array_sort(arr, lambda a, b: F.when(a["score"] > b["score"], -1)
                                           .when(a["score"] < b["score"], 1)
                                           .when(a["neg_pos"] > b["neg_pos"], -1)
                                           .when(a["neg_pos"] < b["neg_pos"], 1).otherwise(0)), 1)
    else:
        chosen = F.get(arr, 0)
    out = once(out, "__c", F.when(F.size(arr) > 0, chosen))
    return out.select(
        *[c for c in df.columns],
        F.coalesce(F.col("__c.category"), F.lit(UNCATEGORIZED)).alias(out_col),
        F.round(F.coalesce(F.col("__c.score"), F.lit(0.0)), 6).alias("match_score"),
        F.coalesce(F.array_join(F.col("__c.hits"), ", "), F.lit("")).alias("matched_keywords"),
    )


def paired_labels(df: DataFrame, text_cols, core: Lexicon, additional: Lexicon,
                  out_col: str = "primary_category") -> DataFrame:
    """C3: 'core + additional' for every matching pair; else matching cores alone; else Uncategorized."""
    out, hit = _with_hits(df, text_cols, core, additional)
    core_hits = _phrase_hits(hit, core)
    add_hits = _phrase_hits(hit, additional)
    pairs = F.flatten(F.transform(core_hits, lambda c: F.transform(add_hits, lambda a: F.concat(c, F.lit(PAIR_SEPARATOR), a))))
    label = (F.when(F.size(pairs) > 0, F.array_join(F.array_sort(pairs), LABEL_SEPARATOR))
             .when(F.size(core_hits) > 0, F.array_join(F.array_sort(core_hits), LABEL_SEPARATOR))
             .otherwise(F.lit(UNCATEGORIZED)))
    return once(out, out_col, label).drop("__search", "__hit")


def substring_category(df: DataFrame, lexicon: Lexicon, text_cols=None, category_col: str = "secondary_category",
                       keywords_col: str = "secondary_keywords") -> DataFrame:
    """C4: regex-alternation substring match over the lower-cased text; the LAST matching
    category in lexicon order wins; keywords = distinct hits of that category, sorted,
    ', '-joined; no match -> NULL category and '' keywords.

    ``text_cols`` defaults to the frame's original string columns (B12: derived columns such
    as earlier labels are not searched unless passed explicitly).
    """
    cols = text_cols or string_columns(df, exclude=(category_col, keywords_col))
    tmp = "__search"
    out = once(df, tmp, search_text(cols, lower=True))
    cat_expr = F.lit(None).cast("string")
    kw_expr = F.lit("")
    for cat, vs in lexicon.entries:  # later categories overwrite earlier ones
        terms = [v.lower() for v in vs if v]
        if not terms:
            continue
        pattern = alternation(terms)
        hit = F.coalesce(F.col(tmp).rlike(pattern), F.lit(False))
        cat_expr = F.when(hit, F.lit(cat)).otherwise(cat_expr)
        found = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(tmp), F.lit(pattern), 0))), ", ")
        kw_expr = F.when(hit, found).otherwise(kw_expr)
    return once(out, category_col, cat_expr).withColumn(keywords_col, kw_expr).drop(tmp)


def tag_dimensions(df: DataFrame, dimensions: dict[str, Lexicon], text_cols=None) -> DataFrame:
    """One column per dimension, default 'Unknown', last matching category wins.

    Substring (regex alternation) test on the lower-cased text of all original string columns,
    computed once before any dimension column is added; empty term lists are skipped.
    """
    cols = text_cols or string_columns(df, exclude=tuple(dimensions))
    tmp = "__search"
    out = once(df, tmp, search_text(cols, lower=True))
    for dim, lex in dimensions.items():
        expr = F.lit(UNKNOWN)
        for cat, vs in lex.entries:
            terms = [v.lower() for v in vs if v]
            if not terms:
                continue
            expr = F.when(F.coalesce(F.col(tmp).rlike(alternation(terms)), F.lit(False)), F.lit(cat)).otherwise(expr)
        out = out.withColumn(dim, expr)
    return out.drop(tmp)


def split_matched(df: DataFrame, category_col: str, unmatched_value: str | None = UNCATEGORIZED):
    """(matched, unmatched) with a NULL-safe complement.

    ``unmatched_value=None`` means NULL marks unmatched rows (C4).
    """
    if unmatched_value is None:
        is_unmatched = F.col(category_col).isNull()
    else:
        is_unmatched = F.col(category_col).eqNullSafe(F.lit(unmatched_value))
    return df.filter(~is_unmatched), df.filter(is_unmatched)


def label_counts(df: DataFrame, label_col: str = "primary_category") -> DataFrame:
    """Papers per single category of a ', '-joined multi-label column."""
    return (df.select(F.explode(F.split(F.col(label_col), LABEL_SEPARATOR)).alias("category"))
            .groupBy("category").agg(F.count(F.lit(1)).alias("n_papers")))


def category_crosstab(df: DataFrame, a: str = "primary_category", b: str = "secondary_category") -> DataFrame:
    """Counts per (primary, secondary) pair."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n_papers"))
