"""Column expressions for text.

All of them are built-in Spark functions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from litsieve.functions.columns import col_of

# Python's str.strip() removes any whitespace at both ends; Spark's trim only blanks.
_OUTER_WS = r"^\s+|\s+$"
# Python's Unicode \w = letters, digits, underscore.
_NON_WORD = r"[^\p{L}\p{N}_\s]"


def search_text(cols: Iterable, lower: bool = False) -> Column:
    """Null-skipping blank-join of the columns, as text (empty strings are kept)."""
    joined = F.concat_ws(" ", *[col_of(c).cast("string") for c in cols])
    return F.lower(joined) if lower else joined


def py_strip(c) -> Column:
    """Outer whitespace strip with Python semantics (newlines and tabs too)."""
    return F.regexp_replace(col_of(c), _OUTER_WS, "")


def match_key(c) -> Column:
    """Lower, drop every char that is neither word nor whitespace, strip the ends.

    Inner whitespace is kept as it is (the reference does not collapse it).
    """
    return py_strip(F.regexp_replace(F.lower(col_of(c)), _NON_WORD, ""))


def norm_key(c) -> Column:
    """P5: lower + outer strip of a text key."""
    return py_strip(F.lower(col_of(c).cast("string")))


_WS = "\t\n\u000b\f\r"


def words(c, lower: bool = True) -> Column:
    """Whitespace-separated words (the \\s class: blank, tab, newline, VT, FF, CR), no empties.

    Whitespace is first mapped to blanks so the split runs on a single literal character,
    which avoids the regex engine."""
    x = F.lower(col_of(c)) if lower else col_of(c)
    return F.filter(F.split(F.translate(x, _WS, " " * len(_WS)), " "), lambda w: w != F.lit(""))


def word_set(c) -> Column:
    """P20: distinct lower-cased whitespace words."""
    return F.array_distinct(words(c))


def padded_contains(text, term: str) -> Column:
    """Whole-phrase test ' term ' inside ' text ' (blank-delimited only)."""
    return F.instr(F.concat(F.lit(" "), col_of(text), F.lit(" ")), f" {term} ") > 0


def comma_terms(c, lower: bool = True) -> Column:
    """Comma list -> trimmed, non-empty terms."""
    parts = F.transform(F.split(col_of(c), ","), lambda y: F.lower(py_strip(y)) if lower else py_strip(y))
    return F.filter(parts, lambda y: y != F.lit(""))


def has_text(c) -> Column:
    """P10: true when the text has something besides whitespace (use as an explicit filter)."""
    return F.coalesce(F.length(py_strip(col_of(c))) > 0, F.lit(False))


def percent(removed, original) -> Column:
    """Share removed in percent, one decimal; NULL when nothing was there."""
    return F.round(F.lit(100.0) * col_of(removed) / F.nullif(col_of(original), F.lit(0)), 1)


_REGEX_META = set("\\^$.|?*+()[]{}")


def regex_escape(term: str) -> str:
    """Escape regex metacharacters; the result is valid for Java regex and RE2 alike."""
    return "".join("\\" + ch if ch in _REGEX_META else ch for ch in term)


def alternation(terms: Iterable[str]) -> str:
    """Leftmost-first alternation of escaped terms, in the given order."""
    return "|".join(regex_escape(t) for t in terms)
