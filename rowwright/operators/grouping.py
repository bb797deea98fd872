"""Grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import as_list, col, is_binary_float, is_present, kind_of, reject_ambiguous, require_columns

AGGREGATES = ("mean", "avg", "sum", "max", "min", "count", "nunique", "std", "var")


def aggregate(func: str, name: str, dtype: T.DataType, approximate: bool = False) -> Column:
    """An aggregate that skips missing values; the sum of nothing is 0."""
    value = col(name)
    if is_binary_float(dtype):
        value = F.when(~F.isnan(value), value)
    if func in ("mean", "avg"):
        return F.avg(_numeric(value, dtype))
    if func == "sum":
        total = F.sum(_numeric(value, dtype))
        if isinstance(dtype, T.DecimalType):  # the sum of decimals is one, ten digits wider
            return F.coalesce(total, F.lit(0).cast(T.DecimalType(min(38, dtype.precision + 10), dtype.scale)))
        return F.coalesce(total, F.lit(0.0) if kind_of(dtype) == "float" else F.lit(0).cast("bigint"))
    if func == "nunique":
        return F.approx_count_distinct(value) if approximate else F.count_distinct(value)
    plain = {"max": F.max, "min": F.min, "count": F.count, "std": F.stddev_samp, "var": F.var_samp}
    if func not in plain:
        raise ValueError(f"unknown aggregate {func!r}; known are {AGGREGATES}")
    return plain[func](_numeric(value, dtype) if func in ("std", "var") else value)


def _numeric(value: Column, dtype: T.DataType) -> Column:
    return value.cast("bigint") if isinstance(dtype, T.BooleanType) else value


def group_rows(df: DataFrame, by, agg: dict[str, str | list[str]], naming: str = "original",
               approximate: bool = False) -> DataFrame:
    """One row per key; rows with a missing key are left out.

    Results keep the name of their column, or get ``{column}_{func}`` with
    ``naming="suffix"`` and wherever one column has several functions.
    """
    keys = as_list(by)
    require_columns(df, [*keys, *agg], "groupby")
    both = [k for k in keys if k in agg]
    if both:
        raise ValueError(f"groupby: key columns {both} cannot be aggregated as well")
    results, labels = [], []
    for name, funcs in agg.items():
        several = not isinstance(funcs, str)
        for func in as_list(funcs):
            label = f"{name}_{func}" if several or naming == "suffix" else name
            labels.append(label)
            results.append(aggregate(func.lower(), name, df.schema[name].dataType, approximate).alias(label))
    reject_ambiguous([*keys, *labels], "groupby")
    for key in keys:
        df = df.filter(is_present(col(key), df.schema[key].dataType))
    return df.groupBy(*[col(k) for k in keys]).agg(*results)
