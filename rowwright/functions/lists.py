"""Lists written as text."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a lone number, a quoted text and a round-bracket list look.
LONE_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
LONE_QUOTED = r"""^\s*(?:'([^'\\]*)'|"([^"\\]*)")\s*$"""
ROUND_LIST = r"^\s*\((.*?),?\s*\)\s*$"
# Every blank character, beyond the few that \s stands for, and the
# UTF-8 bytes (in hex) that text holds if it has one of those beyond \s.
BLANK = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
RARE_BLANK_BYTES = ("1C", "1D", "1E", "1F", "C285", "C2A0", "E19A80", "E280", "E2819F", "E38080")


def split_comma(column: Column) -> Column:
    """Pieces between commas, blanks kept."""
    return F.split(column, ",", -1)


def split_blank(column: Column) -> Column:
    """Words between blanks; blank text has none.

    A byte search finds the texts that need the wide pattern, which is several times slower.
    """
    raw = column.cast("binary")
    rare = reduce(operator.or_, [raw.contains(F.unhex(F.lit(h))) for h in RARE_BLANK_BYTES])
    words = F.when(rare, F.split(column, f"{BLANK}+", -1)).otherwise(F.split(column, r"\s+", -1))
    return F.array_remove(words, "")


def parse_literal(column: Column) -> Column:
    """Elements of a list literal, or the single value of a scalar literal; else null."""
    bracketed = F.regexp_replace(column, ROUND_LIST, "[$1]")
    listed = F.when(bracketed.rlike(r"(?s)^\s*\[.*\]\s*$"), F.from_json(bracketed, "array<string>"))
    inner = F.concat(F.regexp_extract(column, LONE_QUOTED, 1), F.regexp_extract(column, LONE_QUOTED, 2))
    return F.coalesce(
        listed,
        F.when(column.rlike(LONE_NUMBER), F.array(F.trim(column))),
        F.when(column.rlike(LONE_QUOTED), F.array(inner)),
    )
