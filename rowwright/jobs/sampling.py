"""Reproducible choices, samples and splits, all driven by a hash of seed and key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import RANGE, RANGE_BITS, draw, draw_name, share
from ..functions.names import col
from ..functions.ranking import rank_by_draw

# Shares of the splits and of the difficulty strata.
OVERLAP_KEYS = 1 / 3
BASE_ROWS, OVERLAP_ROWS, NULLED_ROWS = 0.6, 0.3, 0.1
LOW_SHARE, MIDDLE_SHARE, SINGLE_STEP_SHARE = 0.15, 0.55, 0.6
DRAW = "__draw"
TOP_N = 10_000  # largest sample taken as a top-n, and rows looked at one by one
SLICE_BITS = 10  # leading bits of draws that are counted at a time


def weighted_choice(key: Column, weights: dict[str, float], seed: object = 0) -> Column:
    """One of the names per key, with probability in proportion to its weight."""
    total, bound, names = sum(weights.values()), 0.0, list(weights)
    number, choice = draw(key, seed), None
    for name in names[:-1]:
        bound += weights[name]
        hit = number < int(bound / total * RANGE)
        choice = F.when(hit, name) if choice is None else choice.when(hit, name)
    return F.lit(names[-1]) if choice is None else choice.otherwise(names[-1])


def first_drawn(df: DataFrame, group: Column, key: Column, limits: dict[object, int], seed: object = 0) -> Column:
    """A condition for the ``limits[g]`` rows of each group ``g`` that are drawn first; ties of draws follow the key.

    Counts of draws by their leading bits find the slice in which a group's last row lies, further bits inside
    that slice find it closer, until the rows there are few enough to look at.  Nothing is shuffled but counts, and the
    sample itself is a filter on the rows where they are.  ``key`` identifies the rows; rows without key are never drawn.
    """
    drawn = df.select(group.alias("g"), draw(key, seed).alias("d"), key.alias("k"))
    ends: dict[object, tuple] = {}  # draw and key of the last row taken
    still = {g: (0, n) for g, n in limits.items() if n > 0}  # start of the slice, rows wanted from it
    bits = RANGE_BITS
    while still:
        width = max(0, bits - SLICE_BITS)
        inside = reduce(Column.__or__, [(F.col("g") == g) & (F.shiftright("d", bits) == low >> bits) for g, (low, _) in still.items()])
        found = drawn.filter(inside).groupBy("g", F.shiftright("d", width).alias("slice")).count().collect()
        held: dict[object, dict[int, int]] = {g: {} for g in still}
        for r in found:
            held[r.g][r.slice] = r["count"]
        open_rows = 0
        for g, (_, wanted) in list(still.items()):
            for at in sorted(held[g]):
                if wanted <= held[g][at]:
                    break
                wanted -= held[g][at]
            else:  # the group has no more rows than are wanted of it
                ends[g] = (RANGE, None)
                del still[g]
                continue
            still[g] = (at << width, wanted)
            open_rows += held[g][at]
        bits = width
        if still and (open_rows <= TOP_N or not bits):
            inside = reduce(Column.__or__, [(F.col("g") == g) & (F.shiftright("d", bits) == low >> bits) for g, (low, _) in still.items()])
            near = drawn.filter(inside)
            for g, (_, wanted) in still.items() if open_rows > TOP_N else ():
                last = near.filter(F.col("g") == g).orderBy("k").limit(wanted).agg(F.max("d"), F.max("k")).first()
                ends[g] = tuple(last)
            if open_rows <= TOP_N:
                rows = sorted(near.collect(), key=lambda r: (r.d, r.k))
                for g, (_, wanted) in still.items():
                    last = [r for r in rows if r.g == g][wanted - 1]
                    ends[g] = (last.d, last.k)
            break
    number, taken = draw(key, seed), F.lit(False)
    for g, (d, k) in ends.items():
        tied = F.lit(False) if k is None else (number == d) & (key <= F.lit(k))
        taken = taken | ((group == g) & ((number < F.lit(d).cast("bigint")) | tied))
    return taken


def sample_rows(df: DataFrame, key: str, n: int, seed: object = 0) -> DataFrame:
    """``n`` rows without replacement; ``key`` identifies the rows.

    A small sample is a distributed top-n; a large one would meet in one task there,
    so it is cut by counts of draws instead.
    """
    if n <= TOP_N:
        return df.orderBy(draw(col(key), seed), col(key)).limit(n)
    return df.filter(first_drawn(df, F.lit(0), col(key), {0: n}, seed))


def sample_rounds(df: DataFrame, key: str, n: int, seed: object = 0) -> DataFrame:
    """Every row with the ``round`` that draws it when rounds take ``n`` rows each."""
    drawn = df.withColumn(DRAW, draw(col(key), seed))
    ranked = rank_by_draw(drawn, [], DRAW, [key], "__n")
    return ranked.withColumn("round", F.floor((F.col("__n") - 1) / n).cast("bigint")).drop(DRAW, "__n")


def split_columns(columns: list[str], key: str, seed: object = 0) -> tuple[list[str], list[str]]:
    """The other columns in drawn order, half to each side, and the key on both."""
    others = sorted((c for c in columns if c != key), key=lambda c: (draw_name(c, seed), c))
    half = len(others) // 2
    return others[:half] + [key], others[half:] + [key]


def split_for_join(df: DataFrame, key: str, seed: object = 0) -> tuple[DataFrame, DataFrame]:
    """Two tables that join on ``key``: half of the columns and of the keys each,
    and a third of the keys on both sides.  Two narrow passes."""
    half, common = draw(col(key), f"{seed}-side") < RANGE // 2, share(col(key), f"{seed}-both") < OVERLAP_KEYS
    left_columns, right_columns = split_columns(df.columns, key, seed)
    left = df.filter(half | common).select(*[col(c) for c in left_columns])
    right = df.filter(~half | common).select(*[col(c) for c in right_columns])
    return left, right


def split_for_union(df: DataFrame, key: str, seed: object = 0,
                    nulled: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Two overlapping tables that union to the input, the right one with its columns
    in drawn order and a tenth of the cells of ``nulled`` columns missing."""
    base, both = share(col(key), f"{seed}-base") < BASE_ROWS, share(col(key), f"{seed}-both") < OVERLAP_ROWS
    left, right = df.filter(base | both), df.filter(~base | both)
    order = sorted(df.columns, key=lambda c: (draw_name(c, seed), c))
    cells = [
        F.when(share(col(key), f"{seed}-{c}") >= NULLED_ROWS, col(c)).alias(c) if c in (nulled or []) else col(c)
        for c in order
    ]
    return left, right.select(*cells)


def quotas(n: int) -> dict[str, int]:
    """Tasks per difficulty stratum out of ``n``."""
    low, middle = int(n * LOW_SHARE), int(n * MIDDLE_SHARE)
    single = int(low * SINGLE_STEP_SHARE)
    return {"1": single, "2-3": low - single, "4-6": middle, "7+": n - low - middle}


def stratum(complexity: Column) -> Column:
    return (
        F.when(complexity <= 1, "1").when(complexity <= 3, "2-3").when(complexity <= 6, "4-6").otherwise("7+")
    )


def stratified_quota(tasks: DataFrame, key: str, complexity: str, n: int, seed: object = 0) -> DataFrame:
    """A sample of ``n`` tasks with fixed shares per difficulty."""
    named = stratum(col(complexity))
    return tasks.withColumn("stratum", named).filter(first_drawn(tasks, named, col(key), quotas(n), seed))
