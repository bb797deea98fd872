"""Operators that turn rows into columns and columns into rows."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lists import parse_literal, split_blank, split_comma
from ..functions.names import (
    as_list, col, is_binary_float, is_present, kind_of, reject_ambiguous, require_columns,
)
from ..functions.text import shared_text, to_text
from .grouping import aggregate


def _column_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))


def pivot_rows(df: DataFrame, index, columns, values, aggfunc: str = "mean",
               pivot_values: list | None = None) -> DataFrame:
    """One row per ``index``, one column per value of ``columns``.

    A pair without rows is null; a pair whose values are all missing sums and counts
    to 0.  Rows and columns without any result vanish.  The column values come from
    one narrow distinct scan, unless the caller names them in ``pivot_values``.
    """
    index, columns, values = (as_list(x)[0] for x in (index, columns, values))
    require_columns(df, [index, columns, values], "pivot")
    types = {n: df.schema[n].dataType for n in (index, columns, values)}
    rows = df.filter(is_present(col(index), types[index]) & is_present(col(columns), types[columns]))
    if pivot_values is None:
        seen = rows if aggfunc in ("sum", "count") else rows.filter(is_present(col(values), types[values]))
        pivot_values = _header_texts(seen, columns)
        headers = pivot_values
    else:
        headers = [_header_text(v, types[columns]) for v in pivot_values]
    reject_ambiguous([index, *headers], "pivot")

    cell = aggregate(aggfunc, values, types[values]).alias("__cell")
    header = to_text(col(columns), types[columns]).alias("__header")
    cells = rows.groupBy(col(index).alias("__row"), header).agg(cell)
    cells = cells.filter(F.col("__cell").isNotNull() & F.col("__header").isin(headers))
    wide = cells.groupBy("__row").pivot("__header", headers).agg(F.first("__cell"))
    return wide.toDF(index, *headers)


def _header_text(value, dtype: T.DataType) -> str:
    """A given header as cells of that type are spelled."""
    if isinstance(value, str):
        return value
    if is_binary_float(dtype):
        return str(float(value))
    return str(int(value)) if kind_of(dtype) == "int" else str(value)


def _header_texts(df: DataFrame, name: str) -> list[str]:
    """Distinct values of a column that becomes headers: in value order, as text."""
    limit = _column_limit(df)
    distinct = df.select(col(name).alias("value")).distinct()
    spelled = distinct.select("value", to_text(F.col("value"), df.schema[name].dataType).alias("text"))
    found = sorted(tuple(r) for r in spelled.limit(limit + 1).collect())
    if len(found) > limit:
        raise ValueError(f"{name} has more than {limit} values; they cannot become columns")
    return [text for _, text in found]


def unpivot_columns(df: DataFrame, id_vars, value_vars, var_name: str = "variable",
                    value_name: str = "value") -> DataFrame:
    """One row per cell of ``value_vars``, its value as text; missing cells stay."""
    ids, names = as_list(id_vars), as_list(value_vars)
    require_columns(df, [*ids, *names], "unpivot")
    reject_ambiguous([*ids, var_name, value_name], "unpivot")
    spelled = shared_text([df.schema[n] for n in names])
    flat = df.select(*[col(i) for i in ids], *[spelled[n].alias(f"__v{k}") for k, n in enumerate(names)])
    stacked = F.inline(F.array(*[
        F.struct(F.lit(n).alias(var_name), col(f"__v{k}").alias(value_name)) for k, n in enumerate(names)
    ]))
    return flat.select(*[col(i) for i in ids], stacked)


def explode_column(df: DataFrame, column: str, split_comma_text: bool = False,
                   mode: str = "auto") -> DataFrame:
    """One row per element of a list, or of text that holds one.

    Missing and empty lists keep one row.  Text splits on commas on request; otherwise
    it is read as a list literal if every cell is one, else split on blanks.  That
    choice is one aggregate over the column; ``mode="literal"`` or ``"blank"`` skips
    it.  Any other value appears twice.
    """
    require_columns(df, [column], "explode")
    value, kind = col(column), kind_of(df.schema[column].dataType)
    if kind == "list":
        if split_comma_text:
            raise ValueError(f"explode: {column} holds lists already, there is no text to split")
        pieces = value
    elif kind == "text":
        if split_comma_text:
            pieces = split_comma(value)
        elif mode == "literal" or (mode == "auto" and _all_literals(df, column)):
            pieces = parse_literal(value)
        else:
            pieces = split_blank(value)
    else:
        pieces = F.when(value.isNotNull(), F.array(value, value))
    return df.withColumn(column, F.explode_outer(pieces))


def _all_literals(df: DataFrame, column: str) -> bool:
    text = df.select(col(column).alias("text"), parse_literal(col(column)).alias("parsed"))
    odd = text.filter(F.col("text").isNotNull() & F.col("parsed").isNull())
    return odd.isEmpty()


def wide_to_long(df: DataFrame, subnames: list[str], i: list[str], j: str = "variable",
                 sep: str = "_", suffix: str = r"\d+", check_unique: bool = True) -> DataFrame:
    """Fold columns ``{subname}{sep}{suffix}`` into rows, one per suffix.

    Columns are resolved from their names while the plan is built; the data pass is
    narrow.  ``i`` must identify rows: the check groups by it and can be switched off.
    """
    ids = as_list(i)
    require_columns(df, ids, "wide_to_long")
    folded: dict[str, dict[str, str]] = {stub: {} for stub in subnames}
    for stub in subnames:
        pattern = re.compile(re.escape(stub) + re.escape(sep) + f"({suffix})")
        for name in df.columns:
            hit = pattern.fullmatch(name)
            if hit:
                folded[stub][hit.group(1)] = name
    suffixes = list(dict.fromkeys(s for found in folded.values() for s in found))
    if not suffixes:
        raise ValueError(f"wide_to_long: no column looks like {subnames} + {sep!r} + {suffix}")
    if check_unique and not _identifies_rows(df, ids):
        raise ValueError(f"wide_to_long: {ids} does not identify the rows")

    used = {name for found in folded.values() for name in found.values()}
    passed = [c for c in df.columns if c not in used and c not in ids]
    reject_ambiguous([*ids, j, *passed, *subnames], "wide_to_long")
    texts = {stub: shared_text([df.schema[n] for n in found.values()]) for stub, found in folded.items()}
    nothing = F.lit(None).cast("string")
    entries = [
        F.struct(
            _suffix_value(s, suffixes).alias("__j"),
            *[(texts[stub][found[s]] if s in found else nothing).alias(f"__s{k}")
              for k, (stub, found) in enumerate(folded.items())],
        )
        for s in suffixes
    ]
    long = df.select(*[col(c) for c in ids + passed], F.inline(F.array(*entries)))
    return long.select(
        *[col(c) for c in ids], F.col("__j").alias(j), *[col(c) for c in passed],
        *[F.col(f"__s{k}").alias(stub) for k, stub in enumerate(subnames)],
    )


def _suffix_value(text: str, all_texts: list[str]) -> Column:
    """Suffixes that are all numbers become numbers."""
    if all(re.fullmatch(r"\d+", t) for t in all_texts):
        return F.lit(int(text)).cast("bigint")
    if all(re.fullmatch(r"\d+(\.\d+)?", t) for t in all_texts):
        return F.lit(float(text))
    return F.lit(text)


def _identifies_rows(df: DataFrame, names: list[str]) -> bool:
    return df.groupBy(*[col(n) for n in names]).count().filter("count > 1").isEmpty()


def transpose_table(df: DataFrame, headers: list | None = None) -> DataFrame:
    """Swap rows and columns: the first column's values become the headers.

    Every row becomes a column, so the table must have few rows: more than
    ``spark.sql.pivotMaxValues`` is refused, as is a first column with missing or
    repeated values.
    """
    first, others = df.columns[0], df.columns[1:]
    if not others:
        raise ValueError("transpose: needs a second column")
    dtype = df.schema[first].dataType
    texts = df.select(
        to_text(col(first), dtype).alias("__header"),
        *[to_text(col(n), df.schema[n].dataType).alias(f"__v{k}") for k, n in enumerate(others)],
    )
    if headers is None:
        limit = _column_limit(df)
        headers = [r[0] for r in texts.select("__header").limit(limit + 1).collect()]
        if len(headers) > limit:
            raise ValueError(f"transpose: more than {limit} rows cannot become columns")
    if None in headers or max(Counter(headers).values(), default=0) > 1:
        raise ValueError(f"transpose: {first} has missing or repeated values")
    reject_ambiguous([first, *headers], "transpose")
    cells = F.inline(F.array(*[
        F.struct(F.lit(n).alias("__name"), F.col(f"__v{k}").alias("__value")) for k, n in enumerate(others)
    ]))
    stacked = texts.select("__header", cells)
    wide = stacked.groupBy("__name").pivot("__header", headers).agg(F.first("__value"))
    return wide.toDF(first, *headers)
