"""Registered queries: (spark, sf_dir) -> DataFrame, each over the driver's whole tables,
with the DuckDB twin used as the correctness oracle where one exists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.operators import categorize as cz
from litsieve.operators import dedup_exact as dx
from litsieve.operators import summary as sm
from litsieve.plans import lexicons as lx
from litsieve.plans.sqlgen import PAPERS, ident, last_wins_sql, phrase_hits_sql, q, search_sql, strip_sql
from litsieve.schema import papers_view
from litsieve.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PAPER_COLS = ["paper_id", "Title", "Abstract", "Year", "DOI", "Source", "lang"]
PAPER_SELECT = ", ".join(ident(c) for c in PAPER_COLS)
DEDUP_SUBSET = ("Title", "DOI", "Abstract")
TEXT_COLS = ("Title", "Abstract")


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers_view(read_table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- projections (P*)

@register("papers_view", f"SELECT * FROM {PAPERS} p")
def q_papers_view(spark, sf_dir):
    return papers(spark, sf_dir)


@register("search_text", f"SELECT paper_id, {search_sql(['Title', 'DOI', 'Abstract'], lower=False)} AS search_text "
                         f"FROM {PAPERS} p")
def q_search_text(spark, sf_dir):
    from litsieve.functions.text import search_text
    return papers(spark, sf_dir).select("paper_id", search_text(["Title", "DOI", "Abstract"]).alias("search_text"))


@register("match_key", "SELECT paper_id, " + strip_sql(
    "regexp_replace(lower(" + search_sql(["Title", "DOI", "Abstract"], lower=False) + "), '[^\\p{L}\\p{N}_\\s]', '', 'g')")
    + f" AS match_key FROM {PAPERS} p")
def q_match_key(spark, sf_dir):
    from litsieve.functions.text import match_key, search_text
    return papers(spark, sf_dir).select("paper_id", match_key(search_text(["Title", "DOI", "Abstract"])).alias("match_key"))


@register("capped_source", f"SELECT {PAPER_SELECT} FROM {PAPERS} p ORDER BY paper_id LIMIT 100")
def q_capped_source(spark, sf_dir):
    """The per-source cap (max_results) is the feature here."""
    from litsieve.sources.landed import cap_rows
    return cap_rows(papers(spark, sf_dir), 100)


# ---------------------------------------------------------------- exact de-duplication

def _exact_sql(keep: str, case_sensitive=False, missing="empty", subset=DEDUP_SUBSET) -> str:
    keys = []
    for i, c in enumerate(subset):
        k = ident(c)
        if missing == "empty":
            k = f"coalesce({k}, '')"
        if not case_sensitive:
            k = strip_sql(f"lower({k})")
        keys.append(f"{k} AS k{i}")
    names = [f"k{i}" for i in range(len(subset))]
    if missing == "distinct":
        cond = " AND ".join(f"{ident(c)} IS NULL" for c in subset)
        keys.append(f"CASE WHEN {cond} THEN paper_id END AS kmiss")
        names.append("kmiss")
    part = ", ".join(names)
    if keep == "first":
        w = f"row_number() OVER (PARTITION BY {part} ORDER BY paper_id) = 1"
    elif keep == "last":
        w = f"row_number() OVER (PARTITION BY {part} ORDER BY paper_id DESC) = 1"
    else:
        w = f"count(*) OVER (PARTITION BY {part}) = 1"
    return (f"SELECT {PAPER_SELECT} FROM (SELECT *, {w} AS keep_row FROM "
            f"(SELECT *, {', '.join(keys)} FROM {PAPERS} p) k) r WHERE keep_row")


def _exact(keep="first", case_sensitive=False, missing="empty", subset=DEDUP_SUBSET):
    cfg = dx.ExactConfig(subset=subset, keep=keep, case_sensitive=case_sensitive, missing=missing)

    def run(spark, sf_dir):
        return dx.exact_dedup(papers(spark, sf_dir), cfg)
    return run


for _keep in ("first", "last", "none"):
    register(f"exact_{_keep}", _exact_sql(_keep))(_exact(_keep))
register("exact_case_sensitive", _exact_sql("first", case_sensitive=True))(_exact("first", case_sensitive=True))
register("exact_missing_equal", _exact_sql("first", missing="equal", subset=("DOI", "Abstract")))(
    _exact("first", missing="equal", subset=("DOI", "Abstract")))
register("exact_missing_distinct", _exact_sql("first", missing="distinct", subset=("DOI", "Abstract")))(
    _exact("first", missing="distinct", subset=("DOI", "Abstract")))


def _flags_sql() -> str:
    keys = ", ".join(strip_sql(f"lower(coalesce({ident(c)}, ''))") + f" AS k{i}" for i, c in enumerate(DEDUP_SUBSET))
    return (f"SELECT {PAPER_SELECT}, min(paper_id) OVER w AS dup_group, count(*) OVER w AS group_size, "
            f"paper_id <> min(paper_id) OVER w AS is_duplicate FROM (SELECT *, {keys} FROM {PAPERS} p) k "
            f"WINDOW w AS (PARTITION BY k0, k1, k2)")


@register("duplicate_listing", f"SELECT {PAPER_SELECT} FROM ({_flags_sql()}) f WHERE is_duplicate")
def q_duplicate_listing(spark, sf_dir):
    return dx.duplicate_rows(papers(spark, sf_dir), dx.ExactConfig(subset=DEDUP_SUBSET))


@register("duplicate_flags", _flags_sql())
def q_duplicate_flags(spark, sf_dir):
    return dx.duplicate_flags(papers(spark, sf_dir), dx.ExactConfig(subset=DEDUP_SUBSET))


@register("dedup_audit", "SELECT 2 AS stage, 'Duplicate removal' AS action, 'Strict exact matching' AS method, "
          "count(*) AS original_count, count(*) FILTER (WHERE NOT is_duplicate) AS remaining_count, "
          "count(*) FILTER (WHERE is_duplicate) AS removed_count, "
          "round(100.0 * count(*) FILTER (WHERE is_duplicate) / nullif(count(*), 0), 1) AS removed_pct "
          f"FROM ({_flags_sql()}) f")
def q_dedup_audit(spark, sf_dir):
    flags = dx.duplicate_flags(papers(spark, sf_dir), dx.ExactConfig(subset=DEDUP_SUBSET))
    return dx.dedup_audit(flags, "Strict exact matching")


# ---------------------------------------------------------------- categorisation

PADDED = "(' ' || " + search_sql(TEXT_COLS) + " || ' ')"


def _c1_sql() -> str:
    lex = lx.CORE.merged(lx.ADDITIONAL)
    return (f"SELECT paper_id, CASE WHEN len(h) > 0 THEN array_to_string(list_sort(h), ', ') ELSE 'Uncategorized' END "
            f"AS primary_category FROM (SELECT paper_id, {phrase_hits_sql('t', lex)} AS h "
            f"FROM (SELECT paper_id, {PADDED} AS t FROM {PAPERS} p) s) x")


@register("phrase_labels", _c1_sql())
def q_phrase_labels(spark, sf_dir):
    return cz.phrase_labels(papers(spark, sf_dir), TEXT_COLS, lx.CORE, lx.ADDITIONAL).select("paper_id", "primary_category")


@register("phrase_labels_join", _c1_sql())
def q_phrase_labels_join(spark, sf_dir):
    """Same labels through the large-lexicon path (n-gram equi-join), forced on a small lexicon."""
    return cz.phrase_labels_join(papers(spark, sf_dir), TEXT_COLS, lx.CORE.merged(lx.ADDITIONAL)).select(
        "paper_id", "primary_category")


def _scored_sql(strategy: str, min_score: float = 0.5) -> str:
    structs = []
    for pos, (cat, vs) in enumerate(lx.SCORED.entries):
        hits = ("list_filter([" + ", ".join(f"CASE WHEN instr(t, {q(' ' + v.lower() + ' ')}) > 0 THEN {q(v)} END"
                                            for v in vs) + "], lambda x: x IS NOT NULL)")
        structs.append(f"{{'score': len({hits}) / {float(len(vs))}, 'pos': {pos}, 'category': {q(cat)}, "
                       f"'kw': array_to_string({hits}, ', ')}}")
    arr = f"list_filter([{', '.join(structs)}], lambda s: s.score >= {min_score})"
    if strategy == "best":
        pick = f"list_sort(list_transform({arr}, lambda s: {{'neg': -s.score, 'pos': s.pos, 'category': s.category, " \
               f"'score': s.score, 'kw': s.kw}}))[1]"
    else:
        pick = f"{arr}[1]"
    return (f"SELECT paper_id, coalesce(c.category, 'Uncategorized') AS primary_category, "
            f"round(coalesce(c.score, 0.0), 6) AS match_score, coalesce(c.kw, '') AS matched_keywords "
            f"FROM (SELECT paper_id, {pick} AS c FROM (SELECT paper_id, {PADDED} AS t FROM {PAPERS} p) s) x")


def _scored(strategy):
    def run(spark, sf_dir):
        return cz.scored_keywords(papers(spark, sf_dir).select("paper_id", *TEXT_COLS), TEXT_COLS, lx.SCORED,
                                  0.5, strategy).select("paper_id", "primary_category", "match_score", "matched_keywords")
    return run


register("scored_keywords_best", _scored_sql("best"))(_scored("best"))
register("scored_keywords_first", _scored_sql("first"))(_scored("first"))


def _paired_sql() -> str:
    core = phrase_hits_sql("t", lx.CORE)
    add = phrase_hits_sql("t", lx.ADDITIONAL)
    pairs = "flatten(list_transform(c, lambda a: list_transform(d, lambda b: a || ' + ' || b)))"
    return (f"SELECT paper_id, CASE WHEN len({pairs}) > 0 THEN array_to_string(list_sort({pairs}), ', ') "
            f"WHEN len(c) > 0 THEN array_to_string(list_sort(c), ', ') ELSE 'Uncategorized' END AS primary_category "
            f"FROM (SELECT paper_id, {core} AS c, {add} AS d FROM (SELECT paper_id, {PADDED} AS t FROM {PAPERS} p) s) x")


@register("paired_labels", _paired_sql())
def q_paired_labels(spark, sf_dir):
    return cz.paired_labels(papers(spark, sf_dir), TEXT_COLS, lx.CORE, lx.ADDITIONAL).select("paper_id", "primary_category")


ALL_TEXT = ["Title", "Abstract", "Year", "DOI", "Source", "lang"]


def _c4_sql() -> str:
    cat, kw = last_wins_sql("t", lx.SECONDARY, "NULL")
    return (f"SELECT paper_id, {cat} AS secondary_category, {kw} AS secondary_keywords "
            f"FROM (SELECT paper_id, {search_sql(ALL_TEXT)} AS t FROM {PAPERS} p) s")


@register("substring_last_wins", _c4_sql())
def q_substring(spark, sf_dir):
    return cz.substring_category(papers(spark, sf_dir), lx.SECONDARY).select(
        "paper_id", "secondary_category", "secondary_keywords")


def _c5_sql() -> str:
    cols = []
    for dim, lex in lx.DIMENSION_LEXICONS.items():
        cat, _ = last_wins_sql("t", lex, "'Unknown'")
        cols.append(f"{cat} AS {ident(dim)}")
    return f"SELECT paper_id, {', '.join(cols)} FROM (SELECT paper_id, {search_sql(ALL_TEXT)} AS t FROM {PAPERS} p) s"


@register("dimension_tags", _c5_sql())
def q_dimensions(spark, sf_dir):
    return cz.tag_dimensions(papers(spark, sf_dir), lx.DIMENSION_LEXICONS).select("paper_id", *lx.DIMENSION_LEXICONS)


@register("matched_unmatched", "SELECT count(*) AS total_count, "
          "count(*) FILTER (WHERE primary_category <> 'Uncategorized') AS matched_count, "
          f"count(*) FILTER (WHERE primary_category = 'Uncategorized') AS unmatched_count FROM ({_c1_sql()}) c")
def q_matched_unmatched(spark, sf_dir):
    labelled = cz.phrase_labels(papers(spark, sf_dir), TEXT_COLS, lx.CORE, lx.ADDITIONAL)
    return sm.split_counts(labelled, F.col("primary_category") != F.lit(cz.UNCATEGORIZED))


@register("label_counts", "SELECT category, count(*) AS n_papers FROM "
          f"(SELECT unnest(string_split(primary_category, ', ')) AS category FROM ({_c1_sql()}) c) x GROUP BY category")
def q_label_counts(spark, sf_dir):
    return cz.label_counts(cz.phrase_labels(papers(spark, sf_dir), TEXT_COLS, lx.CORE, lx.ADDITIONAL))


@register("category_crosstab", "SELECT primary_category, secondary_category, count(*) AS n_papers FROM "
          f"({_c1_sql()}) a JOIN ({_c4_sql()}) b USING (paper_id) GROUP BY primary_category, secondary_category")
def q_crosstab(spark, sf_dir):
    p = papers(spark, sf_dir)
    both = cz.substring_category(cz.phrase_labels(p, TEXT_COLS, lx.CORE, lx.ADDITIONAL), lx.SECONDARY,
                                 text_cols=ALL_TEXT)
    return cz.category_crosstab(both)


# ---------------------------------------------------------------- counts (G*)

@register("value_counts", f"SELECT \"Source\" AS value, count(*) AS n FROM {PAPERS} p "
          "WHERE \"Source\" IS NOT NULL GROUP BY \"Source\"")
def q_value_counts(spark, sf_dir):
    return sm.value_counts(papers(spark, sf_dir), "Source")


@register("distinct_categories", f"SELECT DISTINCT secondary_category AS value FROM ({_c4_sql()}) c "
          "WHERE secondary_category IS NOT NULL")
def q_distinct_categories(spark, sf_dir):
    return sm.distinct_values(cz.substring_category(papers(spark, sf_dir), lx.SECONDARY), "secondary_category")


# ---------------------------------------------------------------- sinks helpers (K4)

@register("export_key", "SELECT primary_category, substr(regexp_replace(primary_category, '[\\\\/*?:\\[\\]]', '_', 'g'), 1, 31) "
          "AS export_key, count(*) AS n_papers FROM "
          f"({_c1_sql()}) c GROUP BY primary_category")
def q_export_key(spark, sf_dir):
    from litsieve.sinks.files import export_key
    labelled = cz.phrase_labels(papers(spark, sf_dir), TEXT_COLS, lx.CORE, lx.ADDITIONAL)
    return labelled.groupBy("primary_category").agg(F.count(F.lit(1)).alias("n_papers")).select(
        "primary_category", export_key(F.col("primary_category")).alias("export_key"), "n_papers")


# ---------------------------------------------------------------- near / fuzzy / combined

from litsieve.functions.similarity import MERSENNE, minhash_signature, permutations  # noqa: E402
from litsieve.functions.text import search_text as _search_text, word_set  # noqa: E402
from litsieve.operators import dedup_near as dn  # noqa: E402
from litsieve.plans.sqlgen import char_levenshtein, greedy_kept_sql, match_key_sql, words_sql  # noqa: E402

NEAR_COLS = ("Title", "Abstract")   # whole text: first line + rest
FUZZY_COLS = ("Title", "DOI", "Abstract")
COMBINED_COLS = ("Title", "DOI", "Abstract")


def _near_reps_sql(keep="first", cols=NEAR_COLS) -> str:
    agg = "min" if keep in ("first", "none") else "max"
    return (f"SELECT {agg}(paper_id) AS id, any_value(ws) AS ws, count(*) AS group_size FROM "
            f"(SELECT paper_id, {words_sql(search_sql(cols, lower=False))} AS ws FROM {PAPERS} p) w "
            f"GROUP BY CASE WHEN len(ws) > 0 THEN array_to_string(list_sort(ws), ' ') "
            f"ELSE chr(0) || CAST(paper_id AS VARCHAR) END")


def _jaccard_pairs_sql(reps: str, t: float) -> str:
    return (f"SELECT id_a, id_b, i / (na + nb - i) AS jaccard FROM (SELECT a.id AS id_a, b.id AS id_b, "
            f"len(list_intersect(a.ws, b.ws)) AS i, len(a.ws) AS na, len(b.ws) AS nb "
            f"FROM ({reps}) a JOIN ({reps}) b ON a.id < b.id AND len(a.ws) > 0 AND len(b.ws) > 0 "
            f"AND len(b.ws) >= {t} * len(a.ws) - 1e-9 AND len(a.ws) >= {t} * len(b.ws) - 1e-9) x "
            f"WHERE i / (na + nb - i) >= {t} - 1e-9")


@register("minhash_signature", "SELECT paper_id, array_to_string(list_transform(["
          + ", ".join(f"[{a}, {b}]" for a, b in permutations(128)) + "], lambda p: list_min(list_transform("
          "list_transform(" + words_sql('"Title"') + ", lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT), "
          f"lambda h: (h * p[1] + p[2]) % {MERSENNE}))), ',') AS signature FROM {PAPERS} p")
def q_minhash_signature(spark, sf_dir):
    p = papers(spark, sf_dir)
    return p.select("paper_id", F.array_join(minhash_signature(word_set(F.col("Title"))), ",").alias("signature"))


@register("near_pairs", _jaccard_pairs_sql(_near_reps_sql(), 0.85))
def q_near_pairs(spark, sf_dir):
    return dn.near_pairs(papers(spark, sf_dir), dn.NearConfig(text_cols=NEAR_COLS, threshold=0.85))


def _lsh_sql(reps: str, t: float, bands=16, rows=8) -> str:
    perms = "[" + ", ".join(f"[{a}, {b}]" for a, b in permutations(bands * rows)) + "]"
    sig = (f"list_transform({perms}, lambda p: list_min(list_transform(list_transform(ws, lambda w: "
           f"('0x' || substr(md5(w), 1, 7))::BIGINT), lambda h: (h * p[1] + p[2]) % {MERSENNE})))")
    banded = (f"SELECT id, ws, band, sig[band * {rows} + 1: band * {rows} + {rows}] AS bucket FROM "
              f"(SELECT id, ws, {sig} AS sig FROM ({reps}) r WHERE len(ws) > 0) s, range({bands}) b(band)")
    return (f"SELECT id_a, id_b, i / (na + nb - i) AS jaccard FROM (SELECT DISTINCT a.id AS id_a, b.id AS id_b, "
            f"len(list_intersect(a.ws, b.ws)) AS i, len(a.ws) AS na, len(b.ws) AS nb "
            f"FROM ({banded}) a JOIN ({banded}) b ON a.band = b.band AND a.bucket = b.bucket AND a.id < b.id) x "
            f"WHERE i / (na + nb - i) >= {t} - 1e-9")


@register("near_pairs_lsh", _lsh_sql(_near_reps_sql(), 0.85))
def q_near_pairs_lsh(spark, sf_dir):
    return dn.near_pairs(papers(spark, sf_dir), dn.NearConfig(text_cols=NEAR_COLS, threshold=0.85, method="lsh"))


def _near_dedup_sql(keep="first", pairs=_jaccard_pairs_sql) -> str:
    reps = _near_reps_sql(keep)
    return (f"SELECT {PAPER_SELECT} FROM {PAPERS} p WHERE paper_id IN "
            f"({greedy_kept_sql(reps, pairs(reps, 0.85), keep)})")


@register("near_dedup", _near_dedup_sql())
def q_near_dedup(spark, sf_dir):
    return dn.near_dedup(papers(spark, sf_dir), dn.NearConfig(text_cols=NEAR_COLS))


@register("near_dedup_lsh", _near_dedup_sql(pairs=_lsh_sql))
def q_near_dedup_lsh(spark, sf_dir):
    """D12 through LSH candidates; its oracle walks the same bands."""
    return dn.near_dedup(papers(spark, sf_dir), dn.NearConfig(text_cols=NEAR_COLS, method="lsh"))


def _fuzzy_reps_sql(keep="first", cols=FUZZY_COLS) -> str:
    agg = "min" if keep in ("first", "none") else "max"
    return (f"SELECT {agg}(paper_id) AS id, any_value(k) AS k, count(*) AS group_size FROM "
            f"(SELECT paper_id, {match_key_sql(search_sql(cols, lower=False))} AS k FROM {PAPERS} p) w "
            f"GROUP BY CASE WHEN length(k) > 0 THEN k ELSE chr(0) || CAST(paper_id AS VARCHAR) END")


def _edit_pairs_sql(reps: str, threshold: float) -> str:
    """All pairs of alike lengths; an edit takes five distinct 5-grams away at most, so pairs that miss more need no
    distance. Pairs short or repetitive enough to miss all their grams are compared outright."""
    alike = f"least(a.n, b.n) >= {threshold / 100.0} * greatest(a.n, b.n) - 1e-9"
    lost = f"5 * floor({100 - threshold} * greatest(a.n, b.n) / 100.0 + 1e-9)"
    return (f"(WITH ks AS MATERIALIZED (SELECT id, k, length(k) AS n FROM ({reps}) r WHERE length(k) > 0), "
            f"g AS MATERIALIZED (SELECT DISTINCT id, n, substr(k, CAST(i AS BIGINT), 5) AS h FROM (SELECT id, k, n, unnest(range(1, n - 3)) AS i FROM ks) u), "
            f"c AS MATERIALIZED (SELECT id, k, n, coalesce(m, 0) AS m FROM ks LEFT JOIN (SELECT id, count(*) AS m FROM g GROUP BY id) x USING (id)), "
            f"s AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS i FROM g a JOIN g b ON a.h = b.h AND a.id < b.id AND {alike} GROUP BY 1, 2), "
            f"f AS (SELECT id_a, id_b FROM s JOIN c a ON a.id = id_a JOIN c b ON b.id = id_b WHERE i >= greatest(a.m, b.m) - {lost} UNION "
            f"SELECT a.id, b.id FROM c a JOIN c b ON a.id < b.id AND {alike} AND greatest(a.m, b.m) <= {lost}), "
            f"near AS MATERIALIZED (SELECT id_a, id_b, a.k AS ka, b.k AS kb, greatest(a.n, b.n) AS lmax FROM f JOIN c a ON a.id = id_a JOIN c b ON b.id = id_b) "
            f"SELECT id_a, id_b, 100.0 * (1 - d / lmax) AS score FROM (SELECT id_a, id_b, lmax, {char_levenshtein('ka', 'kb')} AS d FROM near) x "
            f"WHERE 100.0 * (1 - d / lmax) >= {threshold} - 1e-9)")


@register("fuzzy_pairs_ratio", _edit_pairs_sql(_fuzzy_reps_sql(), 90))
def q_fuzzy_pairs(spark, sf_dir):
    return dn.fuzzy_pairs(papers(spark, sf_dir), dn.FuzzyConfig(columns=FUZZY_COLS, threshold=90))


def _fuzzy_dedup_sql(threshold, keep="first") -> str:
    reps = _fuzzy_reps_sql(keep)
    return (f"SELECT {PAPER_SELECT} FROM {PAPERS} p WHERE paper_id IN "
            f"({greedy_kept_sql(reps, _edit_pairs_sql(reps, threshold), keep)})")


def _fuzzy(threshold, keep="first"):
    def run(spark, sf_dir):
        return dn.fuzzy_dedup(papers(spark, sf_dir), dn.FuzzyConfig(columns=FUZZY_COLS, threshold=threshold, keep=keep))
    return run


for _preset, _t in dn.PRESETS.items():
    register(f"fuzzy_dedup_{_t}", _fuzzy_dedup_sql(_t))(_fuzzy(_t))
register("fuzzy_keep_last", _fuzzy_dedup_sql(90, "last"))(_fuzzy(90, "last"))
register("fuzzy_keep_none", _fuzzy_dedup_sql(90, "none"))(_fuzzy(90, "none"))


def _combined_sql(keep="first", cols=COMBINED_COLS):
    agg = "min" if keep in ("first", "none") else "max"
    ws = words_sql(search_sql(cols[:1], lower=False))
    k = match_key_sql(search_sql(cols, lower=False))
    reps = (f"SELECT {agg}(paper_id) AS id, any_value(ws) AS ws, any_value(k) AS k, count(*) AS group_size FROM "
            f"(SELECT paper_id, {ws} AS ws, {k} AS k FROM {PAPERS} p) w "
            f"GROUP BY CASE WHEN len(ws) > 0 AND length(k) > 0 THEN array_to_string(list_sort(ws), ' ') || chr(1) || k "
            f"ELSE chr(0) || CAST(paper_id AS VARCHAR) END")
    live = f"SELECT * FROM ({reps}) r WHERE len(ws) > 0 AND length(k) > 0"
    cand = _jaccard_pairs_sql(live, 0.85)
    pairs = (f"SELECT c.id_a, c.id_b, c.jaccard, 100.0 * (1 - {char_levenshtein('a.k', 'b.k')} / "
             f"greatest(length(a.k), length(b.k))) AS score FROM ({cand}) c JOIN ({live}) a ON a.id = c.id_a "
             f"JOIN ({live}) b ON b.id = c.id_b")
    verified = f"SELECT * FROM ({pairs}) v WHERE score >= 90 - 1e-9"
    return reps, verified


def _ratio_sql(x: str, y: str) -> str:
    return (f"CASE WHEN greatest(length({x}), length({y})) = 0 THEN 0.0 ELSE "
            f"100.0 * (1 - {char_levenshtein(x, y)} / greatest(length({x}), length({y}))) END")


def _token_set_pairs_sql() -> str:
    reps, _ = _combined_sql(cols=COMBINED_COLS)
    live = f"SELECT * FROM ({reps}) r WHERE len(ws) > 0 AND length(k) > 0"
    cand = _jaccard_pairs_sql(live, 0.85)
    tw = "list_sort(list_distinct(list_filter(string_split_regex({k}, '\\s+'), lambda x: x <> '')))"
    parts = (f"SELECT c.id_a, c.id_b, c.jaccard, {tw.format(k='a.k')} AS wa, {tw.format(k='b.k')} AS wb "
             f"FROM ({cand}) c JOIN ({live}) a ON a.id = c.id_a JOIN ({live}) b ON b.id = c.id_b")
    sets = ("SELECT id_a, id_b, jaccard, array_to_string(list_sort(list_intersect(wa, wb)), ' ') AS t0, "
            "len(list_intersect(wa, wb)) AS nc, list_filter(wa, lambda x: NOT list_contains(wb, x)) AS ra, "
            f"list_filter(wb, lambda x: NOT list_contains(wa, x)) AS rb FROM ({parts}) p")
    strs = ("SELECT id_a, id_b, jaccard, nc, len(ra) AS na, len(rb) AS nb, t0, "
            "trim(concat_ws(' ', t0, array_to_string(ra, ' '))) AS t1, "
            f"trim(concat_ws(' ', t0, array_to_string(rb, ' '))) AS t2 FROM ({sets}) s")
    score = (f"CASE WHEN nc > 0 AND (na = 0 OR nb = 0) THEN 100.0 ELSE greatest({_ratio_sql('t0', 't1')}, "
             f"{_ratio_sql('t0', 't2')}, {_ratio_sql('t1', 't2')}) END")
    return f"SELECT id_a, id_b, jaccard, score FROM (SELECT *, {score} AS score FROM ({strs}) x) y WHERE score >= 90 - 1e-9"


@register("combined_pairs", _combined_sql()[1])
def q_combined_pairs(spark, sf_dir):
    _, verified = dn.combined_pairs(papers(spark, sf_dir), dn.CombinedConfig(columns=COMBINED_COLS))
    return verified


@register("combined_dedup", f"SELECT {PAPER_SELECT} FROM {PAPERS} p WHERE paper_id IN "
          f"({greedy_kept_sql(_combined_sql()[0], _combined_sql()[1], 'first')})")
def q_combined_dedup(spark, sf_dir):
    return dn.combined_dedup(papers(spark, sf_dir), dn.CombinedConfig(columns=COMBINED_COLS))


@register("pair_quality", "SELECT count(*) FILTER (WHERE f AND t) AS tp, count(*) FILTER (WHERE f) AS n_found, "
          "count(*) FILTER (WHERE t) AS n_truth, round(count(*) FILTER (WHERE f AND t) / nullif(count(*) FILTER (WHERE f), 0), 6) AS precision, "
          "round(count(*) FILTER (WHERE f AND t) / nullif(count(*) FILTER (WHERE t), 0), 6) AS recall, "
          "round(2.0 * count(*) FILTER (WHERE f AND t) / nullif(count(*) FILTER (WHERE f) + count(*) FILTER (WHERE t), 0), 6) AS f1 "
          f"FROM (SELECT coalesce(x.id_a, y.id_a) AS id_a, coalesce(x.id_b, y.id_b) AS id_b, x.id_a IS NOT NULL AS f, "
          f"y.id_a IS NOT NULL AS t FROM ({_lsh_sql(_near_reps_sql(), 0.85)}) x FULL JOIN "
          f"({_jaccard_pairs_sql(_near_reps_sql(), 0.85)}) y ON x.id_a = y.id_a AND x.id_b = y.id_b) z")
def q_pair_quality(spark, sf_dir):
    p = papers(spark, sf_dir)
    found = dn.near_pairs(p, dn.NearConfig(text_cols=NEAR_COLS, method="lsh"))
    truth = dn.near_pairs(p, dn.NearConfig(text_cols=NEAR_COLS))
    return dn.pair_quality(found, truth)


@register("near_audit", "SELECT 2 AS stage, 'Duplicate removal' AS action, 'Near (MinHash 0.85)' AS method, "
          "count(*) AS original_count, count(*) FILTER (WHERE k) AS remaining_count, "
          "count(*) FILTER (WHERE NOT k) AS removed_count, "
          "round(100.0 * count(*) FILTER (WHERE NOT k) / nullif(count(*), 0), 1) AS removed_pct FROM "
          f"(SELECT paper_id IN (SELECT paper_id FROM ({_near_dedup_sql()}) d) AS k FROM {PAPERS} p) x")
def q_near_audit(spark, sf_dir):
    p = papers(spark, sf_dir)
    return dn.dedup_counts(p, dn.near_dedup(p, dn.NearConfig(text_cols=NEAR_COLS)), "Near (MinHash 0.85)")


# ---------------------------------------------------------------- profiling

from litsieve.operators import association as ac  # noqa: E402
from litsieve.operators import profile as pf  # noqa: E402

# every numeric column, read as double
NUM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_SQL = "(SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUM_COLS) + " FROM lineitem)"
PROFILE_TEXT_COLS = ["Title", "Abstract", "Year", "DOI", "Source", "lang"]


def _union(parts):
    return " UNION ALL ".join(parts)


@register("profile_overview", "SELECT CAST(count(*) AS BIGINT) AS n_rows, 6 AS n_columns, CAST(" + " + ".join(
    f"count(*) - count({ident(c)})" for c in PROFILE_TEXT_COLS) + " AS BIGINT) AS n_missing_cells, round(100.0 * (" + " + ".join(
    f"count(*) - count({ident(c)})" for c in PROFILE_TEXT_COLS) + ") / (count(*) * 6), 6) AS missing_cells_pct, "
    f"CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(ident(c) for c in PROFILE_TEXT_COLS)} FROM {PAPERS} d) x) AS BIGINT) "
    "AS n_duplicate_rows, round(100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT "
    f"{', '.join(ident(c) for c in PROFILE_TEXT_COLS)} FROM {PAPERS} d) x)) / count(*), 6) AS duplicate_rows_pct, "
    f"0 AS n_numeric, 6 AS n_text, 0 AS n_other FROM {PAPERS} p")
def q_profile_overview(spark, sf_dir):
    return pf.overview(papers(spark, sf_dir).select(*PROFILE_TEXT_COLS))


def _lineitem(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in NUM_COLS])


def _numeric_sql(c):
    """Sums in whole hundredths (HUGEINT): exact, the same in any order; the variance is rounded as a whole number."""
    return f"""SELECT '{c}' AS "column", n, n_missing, n_nan, n_distinct, min, max, round(s / (n * 100.0), 5) AS mean,
  round(dev, 6) AS std, variance, CAST(s AS DOUBLE) / 100 AS sum, n_zeros, n_negative, max - min AS range,
  round(dev / nullif(s / (n * 100.0), 0), 6) AS cv FROM
(SELECT *, sqrt(CAST(n * s2 - s * s AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) / 100 AS dev, CAST(((n * s2 - s * s) * 100 + n * (n - 1) // 2) // (n * (n - 1)) AS DOUBLE) / 1e6 AS variance FROM
(SELECT count({c}) AS n, count(*) - count({c}) AS n_missing, count(*) FILTER (WHERE isnan({c})) AS n_nan,
  count(DISTINCT {c}) AS n_distinct, min({c}) AS min, max({c}) AS max, count(*) FILTER (WHERE {c} = 0) AS n_zeros,
  count(*) FILTER (WHERE {c} < 0) AS n_negative, sum(CAST(round({c} * 100) AS HUGEINT)) AS s,
  sum(CAST(round({c} * 100) AS HUGEINT) * CAST(round({c} * 100) AS HUGEINT)) AS s2 FROM {LINEITEM_SQL} li) a) b"""


@register("profile_numeric", _union([_numeric_sql(c) for c in NUM_COLS]))
def q_profile_numeric(spark, sf_dir):
    return pf.numeric_summary(_lineitem(spark, sf_dir), NUM_COLS)


@register("profile_quantiles", _union([
    f"SELECT '{c}' AS \"column\", " + ", ".join(
        f"round(quantile_cont({c}, {p}), 6) AS p{int(p * 100):02d}" for p in pf.QUANTILES)
    + f", round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr, "
    f"round((SELECT quantile_cont(abs({c} - m.med), 0.5) FROM {LINEITEM_SQL} li, (SELECT quantile_cont({c}, 0.5) AS med FROM {LINEITEM_SQL} li) m), 6) AS mad "
    f"FROM {LINEITEM_SQL} li" for c in NUM_COLS]))
def q_profile_quantiles(spark, sf_dir):
    return pf.quantile_summary(_lineitem(spark, sf_dir), NUM_COLS)


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events")


@register("profile_moments", _union([
    f"SELECT '{c}' AS \"column\", round(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1)), 6) "
    f"AS skewness, round(kurtosis_pop({c}), 6) AS kurtosis FROM {LINEITEM_SQL} li" for c in NUM_COLS]))
def q_profile_moments(spark, sf_dir):
    return pf.moments(_lineitem(spark, sf_dir), NUM_COLS)


def _pairs_of(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


@register("corr_pearson", _union([f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM {LINEITEM_SQL} li"
                                  for a, b in _pairs_of(NUM_COLS)]))
def q_corr_pearson(spark, sf_dir):
    return pf.pearson_matrix(_lineitem(spark, sf_dir), NUM_COLS)


def _avg_rank_sql(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@register("corr_spearman", "SELECT * FROM (" + _union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(ra, rb), 6) AS corr FROM "
    f"(SELECT {_avg_rank_sql(a)} AS ra, {_avg_rank_sql(b)} AS rb FROM {LINEITEM_SQL} li) r" for a, b in _pairs_of(NUM_COLS)]) + ") s")
def q_corr_spearman(spark, sf_dir):
    return pf.spearman_matrix(_lineitem(spark, sf_dir), NUM_COLS)


def _kendall_sql(a, b):
    """Signed pairs level by level: at each bit of y's rank, rows that agree on the higher bits and
    differ in this one are ordered by it; a window over earlier x counts them. All counts are whole
    numbers (HUGEINT) until the last division, so no order of summation can change them."""
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b,
  round(CAST(s AS DOUBLE) / nullif(sqrt(CAST(n0 - n1 AS DOUBLE) * CAST(n0 - n2 AS DOUBLE)), 0), 6) AS tau_b FROM
(WITH c AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY x) AS x, dense_rank() OVER (ORDER BY y) AS y, CAST(n AS HUGEINT) AS n FROM
   (SELECT {a} AS x, {b} AS y, count(*) AS n FROM {LINEITEM_SQL} li WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2) g),
 lev AS MATERIALIZED (SELECT x, l, y >> (l + 1) AS hi, sum(CASE WHEN (y >> l) & 1 = 1 THEN n ELSE 0 END) AS one,
                             sum(CASE WHEN (y >> l) & 1 = 0 THEN n ELSE 0 END) AS zero
         FROM c, (SELECT unnest(range(31)) AS l) r WHERE (SELECT max(y) FROM c) >> l > 0 GROUP BY 1, 2, 3),
 w AS MATERIALIZED (SELECT one, zero, sum(one) OVER e AS ones, sum(zero) OVER e AS zeros FROM lev
       WINDOW e AS (PARTITION BY l, hi ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT (SELECT sum(CAST(one * coalesce(zeros, 0) - zero * coalesce(ones, 0) AS HUGEINT)) FROM w) AS s,
   (SELECT CAST(sum(n) * (sum(n) - 1) // 2 AS HUGEINT) FROM c) AS n0,
   (SELECT sum(CAST(m * (m - 1) // 2 AS HUGEINT)) FROM (SELECT CAST(sum(n) AS HUGEINT) AS m FROM c GROUP BY x) z) AS n1,
   (SELECT sum(CAST(m * (m - 1) // 2 AS HUGEINT)) FROM (SELECT CAST(sum(n) AS HUGEINT) AS m FROM c GROUP BY y) z) AS n2) k"""


@register("corr_kendall", _union([f"SELECT * FROM ({_kendall_sql(a, b)}) k{i}" for i, (a, b) in enumerate(_pairs_of(NUM_COLS))]))
def q_corr_kendall(spark, sf_dir):
    return ac.kendall_matrix(_lineitem(spark, sf_dir), _pairs_of(NUM_COLS))


def _bin_sql(c, table, bins=10):
    return (f"least(floor(({c} - (SELECT min({c}) FROM {table})) * {bins} / "
            f"((SELECT max({c}) FROM {table}) - (SELECT min({c}) FROM {table}))), {bins - 1})")


@register("chi2_cramers_v", _union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(nn * s - nn, 6) AS chi2, "
    f"round(sqrt((nn * s - nn) / (nn * (least(kx, ky) - 1))), 6) AS cramers_v FROM ("
    f"SELECT sum(n * n / (nx * ny)) AS s, sum(n) AS nn, count(DISTINCT x) AS kx, count(DISTINCT y) AS ky FROM "
    f"(SELECT x, y, count(*) AS n FROM (SELECT {_bin_sql(a, LINEITEM_SQL + ' li')} AS x, {_bin_sql(b, LINEITEM_SQL + ' li')} AS y FROM {LINEITEM_SQL} li) q GROUP BY x, y) c "
    f"JOIN (SELECT x, sum(n) AS nx FROM (SELECT {_bin_sql(a, LINEITEM_SQL + ' li')} AS x, count(*) AS n FROM {LINEITEM_SQL} li GROUP BY 1) q GROUP BY x) rx USING (x) "
    f"JOIN (SELECT y, sum(n) AS ny FROM (SELECT {_bin_sql(b, LINEITEM_SQL + ' li')} AS y, count(*) AS n FROM {LINEITEM_SQL} li GROUP BY 1) q GROUP BY y) ry USING (y)) z"
    for a, b in _pairs_of(NUM_COLS)]))
def q_chi2(spark, sf_dir):
    return ac.chi2_table(_lineitem(spark, sf_dir), _pairs_of(NUM_COLS))


@register("phik")
def q_phik(spark, sf_dir):
    """phi_k of every numeric column pair."""
    return ac.phik_matrix(_lineitem(spark, sf_dir), _pairs_of(NUM_COLS))


@register("interaction_grid", _union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({_bin_sql(a, LINEITEM_SQL + ' li')} AS INTEGER) AS bin_a, "
    f"CAST({_bin_sql(b, LINEITEM_SQL + ' li')} AS INTEGER) AS bin_b, count(*) AS n FROM {LINEITEM_SQL} li GROUP BY 1, 2, 3, 4"
    for a, b in _pairs_of(NUM_COLS)]))
def q_interactions(spark, sf_dir):
    return pf.interactions(_lineitem(spark, sf_dir), NUM_COLS)


@register("histogram", _union([
    f"SELECT '{c}' AS \"column\", CAST(bin AS INTEGER) AS bin, round(lo + bin * ((hi - lo) / 10), 6) AS lower, "
    f"round(lo + (bin + 1) * ((hi - lo) / 10), 6) AS upper, count(*) AS n FROM (SELECT {_bin_sql(c, LINEITEM_SQL + ' li')} AS bin, "
    f"(SELECT CAST(min({c}) AS DOUBLE) FROM {LINEITEM_SQL} li) AS lo, (SELECT CAST(max({c}) AS DOUBLE) FROM {LINEITEM_SQL} li) AS hi FROM {LINEITEM_SQL} li) h "
    f"GROUP BY bin, lo, hi" for c in NUM_COLS]))
def q_histogram(spark, sf_dir):
    return pf.histogram(_lineitem(spark, sf_dir), NUM_COLS)


@register("missing_counts", _union([
    f"SELECT '{c}' AS \"column\", count(*) - count({ident(c)}) AS n_missing, "
    f"round(100.0 * (count(*) - count({ident(c)})) / count(*), 6) AS missing_pct FROM {PAPERS} p"
    for c in ["paper_id"] + PROFILE_TEXT_COLS]))
def q_missing_counts(spark, sf_dir):
    return pf.missing_counts(papers(spark, sf_dir))


@register("nullity_corr", "SELECT 'Abstract' AS col_a, 'DOI' AS col_b, round(corr(CAST(\"Abstract\" IS NULL AS DOUBLE), "
          f"CAST(\"DOI\" IS NULL AS DOUBLE)), 6) AS corr FROM {PAPERS} p")
def q_nullity_corr(spark, sf_dir):
    return pf.nullity_correlation(papers(spark, sf_dir))


@register("nullity_distance", _union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) FILTER (WHERE ({ident(a)} IS NULL) <> ({ident(b)} IS NULL)) AS n_disagree "
    f"FROM {PAPERS} p" for a, b in _pairs_of(["paper_id"] + PROFILE_TEXT_COLS)]))
def q_nullity_distance(spark, sf_dir):
    return pf.nullity_distance(papers(spark, sf_dir))


@register("nullity_merges")
def q_nullity_merges(spark, sf_dir):
    """The merge order of the paper table's columns by their missing values."""
    return pf.nullity_merges(papers(spark, sf_dir))


def _text_sql(c):
    v = ident(c)
    return (f"SELECT '{c}' AS \"column\", CAST(sum(k) AS BIGINT) AS n, min(length(v)) AS len_min, "
            f"round(sum(k * length(v)) / sum(k), 6) AS len_mean, "
            f"(SELECT CAST(median(length({v})) AS DOUBLE) FROM {PAPERS} m) AS len_median, "
            f"max(length(v)) AS len_max, count(*) AS n_distinct, "
            f"count(*) FILTER (WHERE k = 1) AS n_unique, "
            f"CAST(sum(k * len(list_filter(string_split_regex(v, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS n_words, "
            f"CAST(sum(k * length(regexp_replace(v, '[^\\p{{L}}]', '', 'g'))) AS BIGINT) AS n_letters, "
            f"CAST(sum(k * length(regexp_replace(v, '[^\\p{{N}}]', '', 'g'))) AS BIGINT) AS n_digits, "
            f"CAST(sum(k * length(regexp_replace(v, '[^\\s]', '', 'g'))) AS BIGINT) AS n_spaces, "
            f"CAST(sum(k * length(regexp_replace(v, '[^\\p{{P}}]', '', 'g'))) AS BIGINT) AS n_punct "
            f"FROM (SELECT {v} AS v, count(*) AS k FROM {PAPERS} p WHERE {v} IS NOT NULL GROUP BY {v}) g")


@register("profile_text", _union([_text_sql(c) for c in PROFILE_TEXT_COLS]))
def q_profile_text(spark, sf_dir):
    return pf.text_summary(papers(spark, sf_dir), PROFILE_TEXT_COLS)


@register("top_values", f"SELECT \"Title\" AS value, count(*) AS n FROM {PAPERS} p WHERE \"Title\" IS NOT NULL "
          "GROUP BY \"Title\" ORDER BY n DESC, value LIMIT 10")
def q_top_values(spark, sf_dir):
    """E13 top-k report: the ten most frequent titles (the limit is the feature)."""
    return pf.top_values(papers(spark, sf_dir), "Title", 10)


@register("profile_approx_distinct")
def q_approx_distinct(spark, sf_dir):
    """HyperLogLog++ estimates (rows-only check; estimates differ from exact counts)."""
    return pf.approx_distinct(_events(spark, sf_dir))


def _alerts_sql(table: str, cols: list[str]) -> str:
    per = []
    for c in cols:
        stats = (f"SELECT count({c}) AS n, count(*) - count({c}) AS nm, count(DISTINCT {c}) AS nd, "
                 f"count(*) FILTER (WHERE {c} = 0) AS nz, "
                 f"round(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1)), 6) AS sk FROM {table}")
        per.append(f"SELECT '{c}' AS \"column\", unnest([CASE WHEN nd <= 1 THEN 'CONSTANT' END, "
                   f"CASE WHEN 100.0 * nm / (n + nm) > 20.0 THEN 'HIGH_MISSING' END, "
                   f"CASE WHEN nd > 0.5 * (n + nm) THEN 'HIGH_CARDINALITY' END, "
                   f"CASE WHEN nz > 0.1 * (n + nm) THEN 'ZEROS' END, "
                   f"CASE WHEN abs(sk) > 20.0 THEN 'SKEWED' END]) AS alert FROM ({stats}) s")
    corr = [f"SELECT '{a} ~ {b}' AS \"column\", 'HIGH_CORRELATION' AS alert FROM {table} HAVING abs(round(corr({a}, {b}), 6)) > 0.9"
            for a, b in _pairs_of(cols)]
    return "SELECT * FROM (" + _union(per) + ") x WHERE alert IS NOT NULL UNION ALL " + _union(corr)


ALERT_COLS = {"lineitem": NUM_COLS, "events": ["event_id", "user_id", "value"]}  # every numeric column


@register("alerts", _alerts_sql("lineitem", ALERT_COLS["lineitem"]) + " UNION ALL " + _alerts_sql("events", ALERT_COLS["events"]))
def q_alerts(spark, sf_dir):
    """Alert rows derived from E2/E4/E5 over lineitem and events."""
    return pf.alerts(_lineitem(spark, sf_dir), ALERT_COLS["lineitem"]).unionByName(
        pf.alerts(_events(spark, sf_dir), ALERT_COLS["events"]))


# ---------------------------------------------------------------- classification (M1-M8)

from litsieve.operators import classify as cl  # noqa: E402
from litsieve.operators import vectors as vc  # noqa: E402
from litsieve.functions.similarity import cosine  # noqa: E402

# Candidate labels for the zero-shot word-overlap scorer (function words per language).
ZERO_SHOT = {"en": "the of and with", "fr": "le la les des et", "de": "der die das und", "es": "el los las que"}
TOKEN_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


def _labelled(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id")


@register("holdout_split", "SELECT doc_id, ('0x' || substr(md5('42' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 20 "
          "AS is_test FROM labels")
def q_holdout(spark, sf_dir):
    return read_table(spark, sf_dir, "labels").select("doc_id", cl.holdout_flag("doc_id").alias("is_test"))


@register("tfidf", f"""WITH d AS (SELECT doc_id, text FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKEN_SQL}) AS term FROM d) x GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(DISTINCT doc_id) AS n FROM d),
w AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df USING (term), n)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def q_tfidf(spark, sf_dir):
    t = cl.tfidf_long(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return t.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@register("forest_predict")
def q_forest_predict(spark, sf_dir):
    """M3/M4: forest on the training split of labels.quality, predictions for every document."""
    train, _ = cl.holdout_split(_labelled(spark, sf_dir), "doc_id")
    model = cl.fit_forest(train, ["text"], "quality", num_trees=50)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return cl.predict(model, docs, ["text"]).select("doc_id", "prediction")


@register("saved_forest_predict")
def q_saved_forest(spark, sf_dir):
    """K6/M5: the forest saved under its dimension's name, loaded again and applied to every document."""
    train, _ = cl.holdout_split(_labelled(spark, sf_dir), "doc_id")
    root = _shared_folder(spark, "models")
    cl.save_model(cl.fit_forest(train, ["text"], "quality", num_trees=50), root, "quality")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return cl.predict(cl.load_model(root, "quality"), docs, ["text"]).select("doc_id", "prediction")


def _zero_shot_sql() -> str:
    import re
    structs = []
    for pos, (label, desc) in enumerate(ZERO_SHOT.items()):
        dw = sorted(set(t.lower() for t in re.findall(r"\w{2,}", desc)))
        structs.append(f"{{'score': len(list_intersect(w, [{', '.join(q(x) for x in dw)}])) / {float(len(dw))}, "
                       f"'neg_pos': {-pos}, 'label': {q(label)}}}")
    return (f"SELECT paper_id, CASE WHEN b.score > 0 THEN b.label ELSE 'Unknown' END AS prediction FROM "
            f"(SELECT paper_id, list_max([{', '.join(structs)}]) AS b FROM (SELECT paper_id, "
            f"list_distinct(regexp_extract_all(lower({search_sql(TEXT_COLS, lower=False)}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS w "
            f"FROM {PAPERS} p) x) y")


@register("zero_shot_overlap", _zero_shot_sql())
def q_zero_shot(spark, sf_dir):
    return cl.zero_shot_overlap(papers(spark, sf_dir), TEXT_COLS, ZERO_SHOT).select("paper_id", "prediction")


@register("classification_metrics", f"""WITH pr AS (SELECT z.prediction AS pred, p.lang AS label FROM ({_zero_shot_sql()}) z
  JOIN {PAPERS} p USING (paper_id)),
c AS (SELECT label, pred, count(*) AS n FROM pr GROUP BY label, pred),
s AS (SELECT label, sum(n) AS support FROM c GROUP BY label),
pp AS (SELECT pred AS label, sum(n) AS n_pred FROM c GROUP BY pred),
tp AS (SELECT label, n AS tp FROM c WHERE label = pred),
m AS (SELECT coalesce(s.label, pp.label) AS label, coalesce(support, 0) AS support, coalesce(n_pred, 0) AS n_pred
      FROM s FULL JOIN pp ON s.label = pp.label)
SELECT m.label, CAST(support AS BIGINT) AS support,
  round(coalesce(coalesce(tp, 0) / nullif(n_pred, 0), 0), 6) AS precision,
  round(coalesce(coalesce(tp, 0) / nullif(support, 0), 0), 6) AS recall,
  round(coalesce(2 * (coalesce(tp, 0) / nullif(n_pred, 0)) * (coalesce(tp, 0) / nullif(support, 0)) /
        nullif(coalesce(tp, 0) / nullif(n_pred, 0) + coalesce(tp, 0) / nullif(support, 0), 0), 0), 6) AS f1
FROM m LEFT JOIN tp ON tp.label = m.label""")
def q_classification_metrics(spark, sf_dir):
    pred = cl.zero_shot_overlap(papers(spark, sf_dir), TEXT_COLS, ZERO_SHOT)
    per, _ = cl.evaluate(pred, "lang", "prediction")
    return per


@register("classification_accuracy", f"SELECT round(count(*) FILTER (WHERE z.prediction = p.lang) / count(*), 6) AS accuracy, "
          f"count(*) AS n FROM ({_zero_shot_sql()}) z JOIN {PAPERS} p USING (paper_id)")
def q_classification_accuracy(spark, sf_dir):
    pred = cl.zero_shot_overlap(papers(spark, sf_dir), TEXT_COLS, ZERO_SHOT)
    return cl.evaluate(pred, "lang", "prediction")[1]


@register("prediction_counts", f"SELECT prediction AS value, count(*) AS n FROM ({_zero_shot_sql()}) z GROUP BY prediction")
def q_prediction_counts(spark, sf_dir):
    pred = cl.zero_shot_overlap(papers(spark, sf_dir), TEXT_COLS, ZERO_SHOT)
    return sm.value_counts(pred, "prediction")


# ---------------------------------------------------------------- vectors (V1-V6)

def _embeddings(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


CENTROIDS_SQL = ("SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM "
                 "(SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) e "
                 "GROUP BY label, pos) g GROUP BY label")
COS_SQL = ("list_dot_product(CAST(e.embedding AS DOUBLE[]), c.c) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), "
           "CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(c.c, c.c)))")


def _seeds(spark, sf_dir):
    cents = vc.centroids(_embeddings(spark, sf_dir), "embedding", "label")  # one seed a label
    return cents.select(F.concat(F.lit("seed "), F.col("label").cast("string")), "centroid")


@register("cosine_pairs", f"SELECT e.vec_id, round({COS_SQL}, 6) AS cosine FROM embeddings e JOIN ({CENTROIDS_SQL}) c USING (label)")
def q_cosine_pairs(spark, sf_dir):
    """V2: cosine of every vector with its own label's centroid (equi-join on the label)."""
    emb = _embeddings(spark, sf_dir)
    cents = vc.centroids(emb, "embedding", "label")
    return emb.join(cents, "label").select("vec_id", F.round(cosine("embedding", "centroid"), 6).alias("cosine"))


@register("seed_assignment", f"SELECT vec_id, arg_max('seed ' || CAST(c.label AS VARCHAR), {COS_SQL}) AS cluster, "
          f"round(max({COS_SQL}), 6) AS similarity FROM embeddings e, ({CENTROIDS_SQL}) c GROUP BY vec_id")
def q_seed_assignment(spark, sf_dir):
    out = vc.nearest_seed(_embeddings(spark, sf_dir), "embedding", "vec_id", _seeds(spark, sf_dir))
    return out.select("vec_id", "cluster", F.round("similarity", 6).alias("similarity"))


@register("cluster_purity", "SELECT round(sum(m) / sum(t), 6) AS purity, count(*) AS n_clusters FROM (SELECT cluster, "
          "max(n) AS m, sum(n) AS t FROM (SELECT cluster, label, count(*) AS n FROM (SELECT e.vec_id, e.label, "
          f"arg_max('seed ' || CAST(c.label AS VARCHAR), {COS_SQL}) AS cluster FROM embeddings e, ({CENTROIDS_SQL}) c "
          "GROUP BY e.vec_id, e.label) a GROUP BY cluster, label) b GROUP BY cluster) z")
def q_cluster_purity(spark, sf_dir):
    out = vc.nearest_seed(_embeddings(spark, sf_dir), "embedding", "vec_id", _seeds(spark, sf_dir))
    return vc.purity(out, "cluster", "label")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts():
    """A deterministic batch encoder: how often each of the letters a-z stands in a text, capitals included."""
    import numpy as np

    def encode(texts):
        lower = np.char.lower(np.asarray(texts).astype(str))
        return np.stack([np.char.count(lower, x) for x in LETTERS], axis=-1).astype(np.float32)
    return encode


def _letters_sql(text):
    return "[" + ", ".join(f"CAST(len({text}) - len(replace({text}, '{x}', '')) AS FLOAT)" for x in LETTERS) + "]"


@register("embed_encoder", "SELECT doc_id, " + _letters_sql("t") + " AS embedding FROM "
          "(SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) d")
def q_embed_encoder(spark, sf_dir):
    """V1: the whole texts through a batch encoder that each Python worker builds once."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return vc.embed(docs, "text", make_encoder=letter_counts).select("doc_id", "embedding")


@register("kmeans_cosine")
def q_kmeans(spark, sf_dir):
    return vc.kmeans_cosine(_embeddings(spark, sf_dir), "embedding", k=10).select("vec_id", "label", "cluster")


@register("cluster_average_linkage")
def q_average_linkage(spark, sf_dir):
    return vc.average_linkage(_embeddings(spark, sf_dir), "embedding", "vec_id", k=10).select("vec_id", "label", "cluster")


@register("embed_text")
def q_embed_text(spark, sf_dir):
    """V1: default offline encoder (hashed TF-IDF, 256 dims) over every paper's whole text."""
    p = papers(spark, sf_dir).withColumn("text", _search_text(TEXT_COLS))
    return vc.embed(p, "text", dim=256).select("paper_id", "embedding")


# ---------------------------------------------------------------- screening run (A1, A2)

from litsieve.plans import screening as pl  # noqa: E402


def _screening_sql() -> str:
    kept = "SELECT paper_id FROM kept"
    c1 = f"SELECT * FROM ({_c1_sql()}) c WHERE paper_id IN ({kept})"
    c4 = f"SELECT * FROM ({_c4_sql()}) c WHERE paper_id IN (SELECT paper_id FROM ({c1}) m WHERE primary_category <> 'Uncategorized')"
    n_sec = len(lx.SECONDARY.entries)
    return f"""WITH kept AS MATERIALIZED (SELECT paper_id FROM ({q_combined_dedup_sql}) d)
SELECT 2 AS stage, 'Duplicate removal' AS action, 'Combined (MinHash + Fuzzy)' AS method,
  (SELECT count(*) FROM documents) AS original_count, (SELECT count(*) FROM ({kept}) k) AS remaining_count,
  (SELECT count(*) FROM documents) - (SELECT count(*) FROM ({kept}) k) AS removed_count,
  round(100.0 * ((SELECT count(*) FROM documents) - (SELECT count(*) FROM ({kept}) k)) / (SELECT count(*) FROM documents), 1) AS removed_pct
UNION ALL BY NAME
SELECT 3 AS stage, 'Primary categorization' AS action, 'Standalone Exact-Match' AS method,
  count(*) FILTER (WHERE primary_category <> 'Uncategorized') AS matched_count,
  count(*) FILTER (WHERE primary_category = 'Uncategorized') AS unmatched_count,
  count(DISTINCT primary_category) FILTER (WHERE primary_category <> 'Uncategorized') AS categories_created FROM ({c1}) a
UNION ALL BY NAME
SELECT 4 AS stage, 'Secondary categorization' AS action, CAST(NULL AS VARCHAR) AS method,
  count(*) FILTER (WHERE secondary_category IS NOT NULL) AS matched_count,
  count(*) FILTER (WHERE secondary_category IS NULL) AS unmatched_count, CAST({n_sec} AS BIGINT) AS categories_created FROM ({c4}) b
UNION ALL BY NAME
SELECT 5 AS stage, 'Manual analysis' AS action, {q(', '.join(lx.DIMENSION_LEXICONS))} AS dimensions"""


q_combined_dedup_sql = ORACLE["combined_dedup"]


@register("screening_summary", _screening_sql())
def q_screening_summary(spark, sf_dir):
    """A1/A2: the audit table of the default screening run (combined de-dup, then C1, C4, C5)."""
    return pl.run_screening(papers(spark, sf_dir)).summary


def _screening_default_sql() -> str:
    kept = f"SELECT paper_id FROM ({ORACLE['combined_dedup']}) d"
    return (f"SELECT c1.paper_id, c1.primary_category, c4.secondary_category, c4.secondary_keywords, "
            + ", ".join(f"c5.{ident(d)}" for d in lx.DIMENSION_LEXICONS)
            + f" FROM ({_c1_sql()}) c1 JOIN ({_c4_sql()}) c4 USING (paper_id) JOIN ({_c5_sql()}) c5 USING (paper_id) "
            f"WHERE c1.paper_id IN ({kept}) AND c1.primary_category <> 'Uncategorized' AND c4.secondary_category IS NOT NULL")


@register("screening_default", _screening_default_sql())
def q_screening_default(spark, sf_dir):
    """A2: the processed papers of the default screening run, with all stage columns."""
    res = pl.run_screening(papers(spark, sf_dir))
    return res.processed.select("paper_id", "primary_category", "secondary_category", "secondary_keywords",
                                *lx.DIMENSION_LEXICONS)


@register("screening_resumed", _screening_default_sql())
def q_screening_resumed(spark, sf_dir):
    """A2 + K5: a run that ended after de-duplication is taken up again from its saved stage."""
    p, root = papers(spark, sf_dir), _shared_folder(spark, "screening")
    pl.run_screening(p, root=root, last_stage=2)
    res = pl.run_screening(p, root=root)
    return res.processed.select("paper_id", "primary_category", "secondary_category", "secondary_keywords",
                                *lx.DIMENSION_LEXICONS)


@register("combined_pairs_token_set", _token_set_pairs_sql())
def q_combined_pairs_token_set(spark, sf_dir):
    """Near-duplicate candidates verified with the token-set scorer instead of the ratio."""
    _, verified = dn.combined_pairs(papers(spark, sf_dir), dn.CombinedConfig(columns=COMBINED_COLS, scorer="token_set"))
    return verified


# ---------------------------------------------------------------- sinks and sources round trip

@register("csv_roundtrip", f"SELECT * FROM {PAPERS} p")
def q_csv_roundtrip(spark, sf_dir):
    """K1 + S1: the whole paper table written as CSV into the shared checkpoint folder and read
    back (header, quoted newlines and commas, outer blanks kept, NULL vs '' kept)."""
    import os
    import uuid

    from litsieve.session import ensure_checkpoint_dir
    from litsieve.sinks.files import write_csv
    from litsieve.sources.landed import read_csv_table
    p = papers(spark, sf_dir)
    path = os.path.join(ensure_checkpoint_dir(spark), f"csv-roundtrip-{uuid.uuid4().hex}")
    write_csv(p, path, columns=p.columns)
    back = read_csv_table(spark, path, infer=False)
    return back.select(F.col("paper_id").cast("bigint").alias("paper_id"), *[F.col(c) for c in p.columns[1:]])


def _shared_folder(spark, prefix: str) -> str:
    import os
    import uuid

    from litsieve.session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), f"{prefix}-{uuid.uuid4().hex}")


@register("csv_typed_roundtrip", "SELECT event_id, ts, user_id, event_type, value FROM events")
def q_csv_typed(spark, sf_dir):
    """The events written as split CSV files and read with inferred types (whole numbers, doubles, timestamps)."""
    from litsieve.sinks.files import write_csv
    from litsieve.sources.landed import read_csv_table
    cols = ["event_id", "ts", "user_id", "event_type", "value"]
    path = _shared_folder(spark, "csv-typed")
    write_csv(read_table(spark, sf_dir, "events"), path, columns=cols)
    back = read_csv_table(spark, path, infer=True, multi_line=False)
    return back.select(*[F.col(c).cast("long") if t == "int" else F.col(c) for c, t in back.dtypes])


@register("stage_roundtrip", ORACLE["exact_first"])
def q_stage_roundtrip(spark, sf_dir):
    """K5 + S2: stage-2 output saved as a Parquet stage checkpoint and read back."""
    from litsieve.sinks.files import save_stage
    out = save_stage(_shared_folder(spark, "stages"), 2, dx.exact_dedup(papers(spark, sf_dir), dx.ExactConfig()))
    return spark.read.parquet(out["processed"])


@register("category_partitions", "SELECT paper_id, primary_category, substr(regexp_replace(primary_category, "
          "'[\\\\/*?:\\[\\]]', '_', 'g'), 1, 31) AS category_key FROM (" + _c1_sql() + ") c")
def q_category_partitions(spark, sf_dir):
    """K3: one output partition per category, read back with its partition key."""
    import os

    from litsieve.sinks.files import write_by_category
    labelled = cz.phrase_labels(papers(spark, sf_dir), TEXT_COLS, lx.CORE, lx.ADDITIONAL).select(
        "paper_id", "primary_category")
    root = _shared_folder(spark, "by-category")
    write_by_category(labelled, os.path.join(root, "papers"))
    # explicit schema: the partition key stays text (no type inference on key values)
    return spark.read.schema("paper_id bigint, primary_category string, category_key string").parquet(
        os.path.join(root, "papers"))



@register("crossref_roundtrip", "SELECT " + strip_sql('"Title"') + " AS \"Title\", coalesce(" + strip_sql('"Abstract"')
          + ", '') AS \"Abstract\", \"Year\", coalesce(\"DOI\", '') AS \"DOI\", 'Crossref' AS \"Source\" "
          f"FROM {PAPERS} p")
def q_crossref_roundtrip(spark, sf_dir):
    """S5 (+ S7 source tag): the paper table landed as Crossref response pages of at most 100
    works (JSON Lines, one page per line), then read with the Crossref mapping."""
    import os

    from litsieve.sources.landed import read_crossref
    p = papers(spark, sf_dir)
    item = F.struct(F.array(F.col("Title")).alias("title"), F.col("Abstract").alias("abstract"),
                    F.struct(F.array(F.array(F.col("Year").cast("int"))).alias("date-parts")).alias("created"),
                    F.col("DOI").alias("DOI"))
    # pages of <= 100 items, like the API's result cap: every group is bounded
    pages = (p.groupBy(F.floor(F.col("paper_id") / 100).alias("page"))
             .agg(F.collect_list(item).alias("items"))
             .select(F.struct(F.col("items")).alias("message")))
    path = os.path.join(_shared_folder(spark, "crossref"), "landed")
    pages.write.json(path)
    return read_crossref(spark, path, multi_line=False).select("Title", "Abstract", "Year", "DOI", "Source")



@register("pubmed_roundtrip", "SELECT " + strip_sql('"Title"') + " AS \"Title\", "
          "coalesce(" + strip_sql('"Abstract"') + ", '') AS \"Abstract\", \"Year\", coalesce(\"DOI\", '') AS \"DOI\", "
          f"'PubMed' AS \"Source\" FROM {PAPERS} p")
def q_pubmed_roundtrip(spark, sf_dir):
    """S3: the paper table landed as PubMed EFetch XML with the XML writer, then read with the
    PubMed mapping (tags stripped from titles, first abstract part, PubDate year, DOI id)."""
    import os

    from litsieve.sources.landed import read_pubmed
    p = papers(spark, sf_dir)
    article = F.struct(
        F.col("Title").alias("ArticleTitle"),
        F.struct(F.when(F.col("Abstract").isNotNull(), F.array(F.col("Abstract")))
                 .otherwise(F.array().cast("array<string>")).alias("AbstractText")).alias("Abstract"),
        F.struct(F.struct(F.struct(F.col("Year").alias("Year")).alias("PubDate")).alias("JournalIssue")).alias("Journal"))
    ids = F.when(F.col("DOI").isNotNull(), F.array(F.struct(F.col("DOI").alias("_VALUE"), F.lit("doi").alias("_IdType"))))
    landed = p.select(F.struct(article.alias("Article")).alias("MedlineCitation"),
                      F.struct(F.struct(ids.alias("ArticleId")).alias("ArticleIdList")).alias("PubmedData"))
    path = os.path.join(_shared_folder(spark, "pubmed"), "landed")
    landed.write.format("xml").option("rootTag", "PubmedArticleSet").option("rowTag", "PubmedArticle").save(path)
    return read_pubmed(spark, path).select("Title", "Abstract", "Year", "DOI", "Source")


# ---------------------------------------------------------------- helpers as queries

def _fuzzy_scored_sql(min_score: float = 0.5) -> str:
    structs = []
    for pos, (cat, vs) in enumerate(lx.SCORED.entries):
        hit = [f"instr(t, {q(' ' + v.lower() + ' ')}) > 0" for v in vs]
        hits = ("list_filter([" + ", ".join(f"CASE WHEN {h} THEN {q(v)} END" for h, v in zip(hit, vs))
                + "], lambda x: x IS NOT NULL)")
        near = " + ".join(
            f"CASE WHEN {h} THEN 1.0::DOUBLE ELSE coalesce(list_max(list_transform(ws, lambda w: 1.0::DOUBLE - "
            f"{char_levenshtein('w', q(v.lower()))} / greatest(length(w), {len(v)}))), 0.0) END" for h, v in zip(hit, vs))
        structs.append(f"{{'neg': -(({near}) / {float(len(vs))}::DOUBLE), 'pos': {pos}, 'category': {q(cat)}, "
                       f"'kw': array_to_string({hits}, ', ')}}")
    return (f"SELECT paper_id, coalesce(c.category, 'Uncategorized') AS primary_category, "
            f"round(coalesce(-c.neg, 0.0), 6) AS match_score, coalesce(c.kw, '') AS matched_keywords FROM (SELECT paper_id, "
            f"list_sort(list_filter([{', '.join(structs)}], lambda s: -s.neg >= {min_score}))[1] AS c FROM (SELECT paper_id, t, "
            f"list_distinct(list_filter(string_split(t, ' '), lambda w: w <> '')) AS ws FROM "
            f"(SELECT paper_id, {PADDED} AS t FROM {PAPERS} p) s) w) x")


@register("scored_keywords_fuzzy", _fuzzy_scored_sql())
def q_scored_fuzzy(spark, sf_dir):
    """C2 with the word-level edit similarity for variants that are not found as they stand."""
    return cz.scored_keywords(papers(spark, sf_dir).select("paper_id", *TEXT_COLS), TEXT_COLS, lx.SCORED, 0.5, "best",
                              fuzzy=True).select("paper_id", "primary_category", "match_score", "matched_keywords")


def _composite_pairs_sql() -> str:
    reps, _ = _combined_sql(cols=COMBINED_COLS)
    live = f"SELECT * FROM ({reps}) r WHERE len(ws) > 0 AND length(k) > 0"
    words = "list_filter(string_split_regex({k}, '\\s+'), lambda x: x <> '')"
    pairs = (f"SELECT c.id_a, c.id_b, c.jaccard, a.k AS ka, b.k AS kb, {words.format(k='a.k')} AS la, {words.format(k='b.k')} AS lb "
             f"FROM ({_jaccard_pairs_sql(live, 0.85)}) c JOIN ({live}) a ON a.id = c.id_a JOIN ({live}) b ON b.id = c.id_b")
    sets = (f"SELECT *, array_to_string(list_sort(la), ' ') AS sa, array_to_string(list_sort(lb), ' ') AS sb, "
            f"list_sort(list_distinct(la)) AS wa, list_sort(list_distinct(lb)) AS wb FROM ({pairs}) p")
    parts = (f"SELECT *, array_to_string(list_sort(list_intersect(wa, wb)), ' ') AS t0, len(list_intersect(wa, wb)) AS nc, "
             f"list_filter(wa, lambda x: NOT list_contains(wb, x)) AS ra, list_filter(wb, lambda x: NOT list_contains(wa, x)) AS rb "
             f"FROM ({sets}) s")
    strs = (f"SELECT *, trim(concat_ws(' ', t0, array_to_string(ra, ' '))) AS t1, "
            f"trim(concat_ws(' ', t0, array_to_string(rb, ' '))) AS t2 FROM ({parts}) y")
    token_set = (f"CASE WHEN nc > 0 AND (len(ra) = 0 OR len(rb) = 0) THEN 100.0 ELSE greatest({_ratio_sql('t0', 't1')}, "
                 f"{_ratio_sql('t0', 't2')}, {_ratio_sql('t1', 't2')}) END")
    score = (f"greatest({_ratio_sql('ka', 'kb')}, 0.95::DOUBLE * ({_ratio_sql('sa', 'sb')}), 0.95::DOUBLE * ({token_set}))")
    return (f"SELECT id_a, id_b, round(jaccard, 9) AS jaccard, round(score, 9) AS score FROM "
            f"(SELECT id_a, id_b, jaccard, {score} AS score FROM ({strs}) z) v WHERE score >= 90 - 1e-9")


@register("combined_pairs_composite", _composite_pairs_sql())
def q_combined_pairs_composite(spark, sf_dir):
    """Near-duplicate candidates verified with the best of the three scorers."""
    _, verified = dn.combined_pairs(papers(spark, sf_dir), dn.CombinedConfig(columns=COMBINED_COLS, scorer="composite"))
    return verified.select("id_a", "id_b", F.round("jaccard", 9).alias("jaccard"), F.round("score", 9).alias("score"))


def _sequential_sql() -> str:
    near = _near_reps_sql(cols=("Title",))
    kept = f"SELECT * FROM {PAPERS} n WHERE paper_id IN ({greedy_kept_sql(near, _jaccard_pairs_sql(near, 0.85), 'first')})"
    reps = _fuzzy_reps_sql().replace(PAPERS, f"({kept})")
    return (f"SELECT {PAPER_SELECT} FROM {PAPERS} p WHERE paper_id IN "
            f"({greedy_kept_sql(reps, _edit_pairs_sql(reps, 90), 'first')})")


@register("combined_dedup_sequential", _sequential_sql())
def q_combined_sequential(spark, sf_dir):
    """D19 as two passes: near de-dup of titles, then fuzzy de-dup of whole papers on what is left."""
    return dn.combined_dedup(papers(spark, sf_dir), dn.CombinedConfig(columns=COMBINED_COLS, mode="sequential"))


@register("drop_empty_text", f"SELECT paper_id FROM {PAPERS} p WHERE length({strip_sql('\"Abstract\"')}) > 0")
def q_drop_empty(spark, sf_dir):
    """P10: papers whose abstract has something besides white space."""
    from litsieve.functions.text import has_text
    return papers(spark, sf_dir).filter(has_text("Abstract")).select("paper_id")


@register("preview_rows", f'SELECT "Title", "Source" FROM {PAPERS} p ORDER BY paper_id LIMIT 5')
def q_preview(spark, sf_dir):
    """The preview (its limit is the feature) of the preferred columns."""
    from litsieve.functions.columns import pick_columns
    from litsieve.sources.landed import preview
    rows = preview(papers(spark, sf_dir))
    return rows.select(*pick_columns(rows, ["Title", "Source"], 5))


_TERMS_SQL = f"list_filter(list_transform(string_split(rest, ','), lambda x: {strip_sql('x')}), lambda x: x <> '')"


@register("lexicon_parse", "SELECT category, min(paper_id) AS position, array_to_string(arg_max(terms, paper_id), '|') AS variants, "
          "CAST(len(arg_max(terms, paper_id)) AS INTEGER) AS n_variants FROM (SELECT paper_id, category, " + _TERMS_SQL
          + " AS terms FROM (SELECT paper_id, " + strip_sql("substr(line, 1, strpos(line, ':') - 1)") + " AS category, "
          "substr(line, strpos(line, ':') + 1) AS rest FROM (SELECT paper_id, CASE WHEN \"DOI\" IS NULL THEN \"Title\" ELSE "
          f"' ' || \"Source\" || ' : ' || replace(\"Title\", ' ', ' , ') END AS line FROM {PAPERS} p) l "
          "WHERE strpos(line, ':') > 0) s) t GROUP BY category")
def q_lexicon_parse(spark, sf_dir):
    """Lexicon lines 'source : word , word ...' made of every paper (those without a DOI give a line
    without a category, unless the title holds a colon), parsed as a Spark job."""
    from litsieve.functions.lexicon import parse_lexicon_lines
    line = F.when(F.col("DOI").isNull(), F.col("Title")).otherwise(
        F.concat(F.lit(" "), F.col("Source"), F.lit(" : "), F.replace(F.col("Title"), F.lit(" "), F.lit(" , "))))
    return parse_lexicon_lines(papers(spark, sf_dir).select(line.alias("line"), F.col("paper_id").alias("line_no")))


def _landed_sql(tag: str) -> str:
    return ("SELECT " + strip_sql('"Title"') + " AS \"Title\", coalesce(" + strip_sql('"Abstract"')
            + f", '') AS \"Abstract\", \"Year\", coalesce(\"DOI\", '') AS \"DOI\", '{tag}' AS \"Source\" FROM {PAPERS} p")


def _with_ids_sql(rows: str) -> str:
    text = "concat_ws(chr(1), " + ", ".join(ident(c) for c in ("Title", "Abstract", "Year", "DOI", "Source")) + ")"
    return f"SELECT row_number() OVER (ORDER BY sha256({text})) - 1 AS paper_id, * FROM ({rows}) r"


def _land_atom(p: DataFrame, path: str) -> None:
    p.select(F.col("Title").alias("title"), F.col("Abstract").alias("summary"),
             F.concat("Year", F.lit("-06-30T12:00:00Z")).alias("published"), F.col("DOI").alias("arxiv:doi")) \
        .write.format("xml").option("rootTag", "feed").option("rowTag", "entry").option("validateName", False).save(path)


def _work(p: DataFrame):
    return F.struct(F.array(F.col("Title")).alias("title"), F.array(F.struct(F.col("Abstract").alias("text"))).alias("abstracts"),
                    F.struct(F.array(F.array(F.col("Year").cast("int"))).alias("date-parts")).alias("published"),
                    F.col("DOI").alias("DOI"))


@register("arxiv_roundtrip", _with_ids_sql(_landed_sql("arXiv")))
def q_arxiv_roundtrip(spark, sf_dir):
    """The paper table landed as Atom entries, read with the arXiv mapping; ids by record digest."""
    from litsieve.sources.landed import read_arxiv
    path = _shared_folder(spark, "arxiv") + "/landed"
    _land_atom(papers(spark, sf_dir), path)
    return read_arxiv(spark, path)


@register("sources_union", _with_ids_sql(_landed_sql("arXiv") + " UNION ALL " + _landed_sql("Crossref")))
def q_sources_union(spark, sf_dir):
    """The paper table landed by two sources (Crossref with `published` and `abstracts`), read and united."""
    from litsieve.sources.landed import read_arxiv, read_crossref, union_sources
    p, root = papers(spark, sf_dir), _shared_folder(spark, "sources")
    _land_atom(p, root + "/arxiv")
    p.select(F.struct(F.array(_work(p)).alias("items")).alias("message")).write.json(root + "/crossref")
    return union_sources([read_arxiv(spark, root + "/arxiv"), read_crossref(spark, root + "/crossref", multi_line=False)])


@register("sources_one_failing", _with_ids_sql(_landed_sql("Crossref")))
def q_sources_one_failing(spark, sf_dir):
    """One source's files are missing; it counts as empty and the other is read."""
    from litsieve.sources.landed import read_arxiv, read_crossref, read_each, union_sources
    p, root = papers(spark, sf_dir), _shared_folder(spark, "failing")
    p.select(F.struct(F.array(_work(p)).alias("items")).alias("message")).write.json(root + "/crossref")
    frames, _ = read_each(spark, {"arXiv": lambda: read_arxiv(spark, root + "/arxiv"),
                                  "Crossref": lambda: read_crossref(spark, root + "/crossref", multi_line=False)})
    return union_sources(list(frames.values()))


@register("quarantine_split", "SELECT CASE WHEN \"DOI\" IS NULL THEN 'quarantined' ELSE 'read' END AS kind, "
          "CASE WHEN \"DOI\" IS NULL THEN '{\"message\": {\"items\": [{\"DOI\": \"' || md5(\"Title\") ELSE "
          + strip_sql('"Title"') + f" END AS content FROM {PAPERS} p")
def q_quarantine(spark, sf_dir):
    """Papers without a DOI are landed as broken Crossref responses; the others are read, these set aside."""
    from litsieve.sources.landed import CORRUPT, read_crossref
    p, path = papers(spark, sf_dir), _shared_folder(spark, "quarantine") + "/landed"
    whole = F.to_json(F.struct(F.struct(F.array(_work(p)).alias("items")).alias("message")))
    broken = F.concat(F.lit('{"message": {"items": [{"DOI": "'), F.md5(F.col("Title")))
    p.select(F.when(F.col("DOI").isNull(), broken).otherwise(whole).alias("value")).write.text(path)
    good, bad = read_crossref(spark, path, with_quarantine=True, multi_line=False)
    return good.select(F.lit("read").alias("kind"), F.col("Title").alias("content")).unionByName(
        bad.select(F.lit("quarantined").alias("kind"), F.col(CORRUPT).alias("content")))


def _export_sql() -> str:
    rows = (f"SELECT CASE WHEN c.primary_category = 'Uncategorized' THEN 'unmatched' ELSE 'processed' END AS part, "
            f"p.\"Title\", p.\"Abstract\", c.primary_category, CAST(NULL AS BIGINT) AS n FROM ({_c1_sql()}) c "
            f"JOIN {PAPERS} p USING (paper_id)")
    counts = (f"SELECT 'summary' AS part, CAST(NULL AS VARCHAR) AS \"Title\", CAST(NULL AS VARCHAR) AS \"Abstract\", "
              f"primary_category, count(*) AS n FROM ({_c1_sql()}) c GROUP BY primary_category")
    return f"SELECT f.format, x.* FROM ({rows} UNION ALL {counts}) x, (VALUES ('parquet'), ('csv')) f(format)"


@register("export_roundtrip", _export_sql())
def q_export(spark, sf_dir):
    """K2/K7: processed, unmatched and summary tables in both formats, all six read back."""
    from litsieve.sinks.files import export_result
    from litsieve.sources.landed import read_csv_table
    labelled = cz.phrase_labels(papers(spark, sf_dir), TEXT_COLS, lx.CORE, lx.ADDITIONAL)
    matched, rest = cz.split_matched(labelled, "primary_category")
    summary = labelled.groupBy("primary_category").agg(F.count(F.lit(1)).alias("n"))
    written = export_result(_shared_folder(spark, "export"), matched, rest, summary)
    out = None
    for key, path in written.items():
        fmt, part = key.split("/")
        rows = spark.read.parquet(path) if fmt == "parquet" else read_csv_table(spark, path, infer=False)

        def col(c, kind):
            return (F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c)
        rows = rows.select(F.lit(fmt).alias("format"), F.lit(part).alias("part"), col("Title", "string"),
                           col("Abstract", "string"), col("primary_category", "string"), col("n", "long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _ml_screening_sql() -> str:
    kept = f"SELECT paper_id FROM ({ORACLE['exact_first']}) d"
    c2 = f"SELECT * FROM ({_scored_sql('best')}) c WHERE paper_id IN ({kept})"
    c4 = f"SELECT * FROM ({_c4_sql()}) c WHERE paper_id IN (SELECT paper_id FROM ({c2}) m WHERE primary_category <> 'Uncategorized')"
    return f"""SELECT c2.paper_id, c2.primary_category, c2.match_score, c4.secondary_category, z.prediction AS "Language"
FROM ({c2}) c2 JOIN ({c4}) c4 USING (paper_id) JOIN ({_zero_shot_sql()}) z USING (paper_id) WHERE c4.secondary_category IS NOT NULL"""


def _ml_run(spark, sf_dir):
    return pl.run_screening(papers(spark, sf_dir), pl.ScreeningConfig(
        dedup="exact", primary="keywords", ml=pl.label_overlap("Language", ZERO_SHOT, TEXT_COLS)))


@register("screening_ml", _ml_screening_sql())
def q_screening_ml(spark, sf_dir):
    """A2 with other choices: exact de-dup, scored keywords, C4, then classification of every processed paper."""
    return _ml_run(spark, sf_dir).processed.select("paper_id", "primary_category", "match_score", "secondary_category", "Language")


@register("screening_ml_audit", "SELECT 5 AS stage, 'ML classification' AS action, 'Use transformer model' AS method, "
          "'Language' AS dimension, CAST(NULL AS BIGINT) AS matched_count UNION ALL SELECT 5, 'Manual analysis', NULL, NULL, NULL "
          "UNION ALL SELECT 2, 'Duplicate removal', 'Strict exact matching', NULL, NULL UNION ALL "
          "SELECT 3, 'Primary categorization', 'Configurable Keyword Matching', NULL, count(*) FILTER (WHERE primary_category <> "
          f"'Uncategorized') FROM ({_scored_sql('best')}) c WHERE paper_id IN (SELECT paper_id FROM ({ORACLE['exact_first']}) d) "
          "UNION ALL SELECT 4, 'Secondary categorization', NULL, NULL, "
          f"(SELECT count(*) FROM ({_ml_screening_sql()}) m)")
def q_screening_ml_audit(spark, sf_dir):
    """A1 with the row and the dimension column of the ML stage."""
    return _ml_run(spark, sf_dir).summary.select("stage", "action", "method", "dimension", "matched_count")
