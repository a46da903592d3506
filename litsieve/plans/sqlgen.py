"""DuckDB text for the oracle side of the registered queries.

The oracle is written independently of the Spark code path: plain SQL over the driver's
views, generated here only where a lexicon has to be spelled out term by term.
"""

from __future__ import annotations

from litsieve.functions.lexicon import Lexicon
from litsieve.functions.text import alternation
from litsieve.schema import PAPERS_SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ident(c: str) -> str:
    return '"' + c + '"'


def search_sql(cols, lower=True) -> str:
    joined = "concat_ws(' ', " + ", ".join(f"CAST({ident(c)} AS VARCHAR)" for c in cols) + ")"
    return f"lower({joined})" if lower else joined


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def phrase_hits_sql(padded: str, lex: Lexicon) -> str:
    whens = []
    for cat, vs in lex.entries:
        if not vs:
            continue
        cond = " OR ".join(f"instr({padded}, {q(' ' + v.lower() + ' ')}) > 0" for v in vs)
        whens.append(f"CASE WHEN {cond} THEN {q(cat)} END")
    return "list_filter([" + ", ".join(whens) + "], lambda x: x IS NOT NULL)"


def last_wins_sql(text: str, lex: Lexicon, default: str) -> tuple[str, str]:
    """CASE for the last matching category and for its distinct sorted hits."""
    cat_case, kw_case = [], []
    for cat, vs in reversed(lex.entries):
        terms = [v.lower() for v in vs if v]
        if not terms:
            continue
        pat = q(alternation(terms))
        cat_case.append(f"WHEN regexp_matches({text}, {pat}) THEN {q(cat)}")
        kw_case.append(f"WHEN regexp_matches({text}, {pat}) THEN "
                       f"array_to_string(list_sort(list_distinct(regexp_extract_all({text}, {pat}))), ', ')")
    cat_sql = "CASE " + " ".join(cat_case) + f" ELSE {default} END"
    kw_sql = "CASE " + " ".join(kw_case) + " ELSE '' END"
    return cat_sql, kw_sql


PAPERS = PAPERS_SQL


# The non-ASCII letters of the driver's prose (lower case). DuckDB's levenshtein
# counts bytes, Spark's counts characters; mapping each letter to one control byte first makes
# the oracle count characters too.
NON_ASCII_LETTERS = "ßäçèéêíñóöü"


def char_levenshtein(a: str, b: str) -> str:
    codes = "".join(chr(i + 1) for i in range(len(NON_ASCII_LETTERS)))

    def tr(x):
        return f"translate({x}, {q(NON_ASCII_LETTERS)}, {q(codes)})"
    return f"levenshtein({tr(a)}, {tr(b)})"


def words_sql(text: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({text}), '\\s+'), lambda x: x <> ''))"


def match_key_sql(text: str) -> str:
    return strip_sql(f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')")


def greedy_kept_sql(reps: str, pairs: str, keep: str) -> str:
    """Ids of ``reps`` (columns id, group_size) kept by the sequential greedy scan over ``pairs``
    (id_a, id_b), folded with a recursive CTE that carries the list of kept positions."""
    if keep == "none":
        return (f"SELECT id FROM ({reps}) r WHERE group_size = 1 AND id NOT IN "
                f"(SELECT id_a FROM ({pairs}) x UNION SELECT id_b FROM ({pairs}) y)")
    direction = "" if keep == "first" else " DESC"
    return f"""
WITH RECURSIVE pr AS MATERIALIZED ({pairs}),
nodes AS (SELECT id_a AS id FROM pr UNION SELECT id_b FROM pr),
ord AS (SELECT id, row_number() OVER (ORDER BY id{direction}) AS i FROM nodes),
e AS (SELECT least(oa.i, ob.i) AS si, greatest(oa.i, ob.i) AS di
      FROM pr JOIN ord oa ON oa.id = pr.id_a JOIN ord ob ON ob.id = pr.id_b),
walk(i, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT w.i + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.di = w.i + 1 AND list_contains(w.kept, e.si))
                       THEN w.kept ELSE list_append(w.kept, w.i + 1) END
  FROM walk w WHERE w.i < (SELECT count(*) FROM ord)),
fin AS (SELECT kept FROM walk ORDER BY i DESC LIMIT 1),
removed AS (SELECT o.id FROM ord o, fin WHERE NOT list_contains(fin.kept, o.i))
SELECT id FROM ({reps}) r WHERE id NOT IN (SELECT id FROM removed)"""
