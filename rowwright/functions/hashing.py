"""Reproducible random numbers: a hash of a seed and a key.

The same row draws the same number in every run, on every executor and in plain
SQL, so a draw can be repeated after a lost executor and checked elsewhere.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE_BITS = 32
RANGE = 2**RANGE_BITS


def draw(key: Column, seed: object) -> Column:
    """Whole number in [0, 2**32)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def share(key: Column, seed: object) -> Column:
    """Fraction in [0, 1)."""
    return draw(key, seed) / F.lit(float(RANGE))


def draw_name(name: str, seed: object) -> int:
    """The same number for a column name, computed while the plan is built."""
    return int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
