"""Category lexicons.

A lexicon is an ordered list of ``(category, variants)``; order matters where the last
matching category wins. Lexicons are user input of bounded size, parsed on the driver; the
same rules are also available as DataFrame code (``parse_lexicon_lines``) for landed files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.functions.text import comma_terms, py_strip


@dataclass(frozen=True)
class Lexicon:
    entries: tuple[tuple[str, tuple[str, ...]], ...]

    @classmethod
    def from_text(cls, text: str, lower: bool = False) -> "Lexicon":
        """``category: v1, v2`` lines, split at the first ':'; lines without ':' ignored.

        A later line for the same category replaces the earlier one and keeps its place.
        Empty variants are dropped (B18).
        """
        entries: dict[str, tuple[str, ...]] = {}
        for line in text.split("\n"):
            if ":" not in line:
                continue
            cat, variants = line.split(":", 1)
            terms = tuple(v.strip().lower() if lower else v.strip() for v in variants.split(","))
            entries[cat.strip()] = tuple(t for t in terms if t)
        return cls(tuple(entries.items()))

    @classmethod
    def from_dict(cls, d: dict, lower: bool = False) -> "Lexicon":
        return cls(tuple((k, tuple(v.lower() if lower else v for v in vs if v.strip())) for k, vs in d.items()))

    @property
    def categories(self) -> list[str]:
        return [c for c, _ in self.entries]

    def merged(self, other: "Lexicon") -> "Lexicon":
        """Union for whole-phrase tagging: a category in both lexicons matches via either list."""
        out: dict[str, tuple[str, ...]] = dict(self.entries)
        for cat, vs in other.entries:
            out[cat] = tuple(dict.fromkeys(out.get(cat, ()) + vs))
        return Lexicon(tuple(out.items()))

    def term_count(self) -> int:
        return sum(len(v) for _, v in self.entries)


def parse_lexicon_lines(lines: DataFrame, line_col: str = "line", order_col: str = "line_no") -> DataFrame:
    """P14 as a Spark job: (line, line_no) rows -> (category, position, variants, n_variants).

    Same rules as ``Lexicon.from_text``; the last line of a category wins and the category
    keeps the position of its first line.
    """
    parts = lines.filter(F.instr(F.col(line_col), ":") > 0).select(
        py_strip(F.substring_index(F.col(line_col), ":", 1)).alias("category"),
        F.expr(f"substr({line_col}, instr({line_col}, ':') + 1)").alias("__rest"),
        F.col(order_col).alias("__pos"),
    )
    return parts.groupBy("category").agg(
        F.min("__pos").alias("position"),
        F.array_join(F.max_by(comma_terms("__rest", lower=False), "__pos"), "|").alias("variants"),
        F.size(F.max_by(comma_terms("__rest", lower=False), "__pos")).alias("n_variants"),
    )
