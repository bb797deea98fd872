"""Operators that keep, order or cut rows."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.condition import to_condition
from ..functions.names import as_list, col, is_binary_float, is_present, nan_as_null, require_columns

RANK = "__rank"


def filter_rows(df: DataFrame, condition: str | Column | None = None) -> DataFrame:
    """Keep rows that satisfy ``condition``; no condition keeps all."""
    if condition is None or (isinstance(condition, str) and not condition.strip()):
        return df
    if not isinstance(condition, str):
        return df.filter(condition)
    try:
        return df.filter(to_condition(condition, df.schema))
    except (AnalysisException, ParseException) as problem:
        raise ValueError(f"cannot use condition: {condition}") from problem


def sort_directions(by, ascending=True) -> list[tuple[str, bool]]:
    """Pairs of column and direction; a list of the wrong length means all ascending."""
    names = as_list(by)
    if isinstance(ascending, (list, tuple)):
        flags = list(ascending) if len(ascending) == len(names) else [True] * len(names)
    else:
        flags = [True if ascending is None else bool(ascending)] * len(names)
    return list(zip(names, flags))


def order_columns(df: DataFrame, directions: list[tuple[str, bool]], reverse: bool = False) -> list[Column]:
    """Sort keys with missing values last; ``reverse`` turns the whole order around."""
    keys = []
    for name, up in directions:
        key = col(name)
        if is_binary_float(df.schema[name].dataType):  # NaN counts as missing, not as the largest number
            key = F.when(~F.isnan(key), key)
        if reverse:
            keys.append(key.desc_nulls_first() if up else key.asc_nulls_first())
        else:
            keys.append(key.asc_nulls_last() if up else key.desc_nulls_last())
    return keys


def sort_rows(df: DataFrame, by, ascending=True) -> DataFrame:
    directions = sort_directions(by, ascending)
    require_columns(df, [n for n, _ in directions], "sort")
    return df.orderBy(*order_columns(df, directions))


def top_rows(df: DataFrame, k: int, order_by: list[tuple[str, bool]] | None = None) -> DataFrame:
    """First ``k`` rows in the given order, else in the order the plan delivers them."""
    if order_by:
        df = df.orderBy(*order_columns(df, order_by))
    return df.limit(k)


def drop_missing(df: DataFrame, subset=None, how: str = "any") -> DataFrame:
    names = as_list(subset) or df.columns
    require_columns(df, names, "dropna")
    present = [is_present(col(n), df.schema[n].dataType) for n in names]
    return df.filter(reduce(operator.and_ if how == "any" else operator.or_, present))


def drop_duplicates(df: DataFrame, subset=None, keep: str = "first",
                    order_by: list[tuple[str, bool]] | None = None) -> DataFrame:
    """One row per distinct ``subset``; without a subset, distinct rows.

    Rows have no position in Spark: "first" follows ``order_by``, and rows equal in
    it (or all rows, when there is none) follow the remaining columns, so the same
    row survives in every run.  The rank limit is applied before the shuffle too,
    which leaves one row per key and task however many copies a key has.  NaN is missing
    and comes out as null.
    """
    names = as_list(subset)
    df = nan_as_null(df)
    if not names or set(names) == set(df.columns):
        return df.dropDuplicates()
    require_columns(df, names, "deduplicate")
    used = {n for n, _ in order_by or []} | set(names)
    rest = [f.name for f in df.schema.fields if f.name not in used and f.dataType.typeName() != "map"]
    keys = order_columns(df, list(order_by or []), reverse=keep == "last")
    keys += order_columns(df, [(n, True) for n in rest], reverse=keep == "last")
    if not keys:
        return df.dropDuplicates(names)
    ranked = Window.partitionBy(*[col(n) for n in names]).orderBy(*keys)
    return df.withColumn(RANK, F.row_number().over(ranked)).filter(F.col(RANK) == 1).drop(RANK)
