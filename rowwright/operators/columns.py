"""Operators that choose, convert and name columns; all of them are narrow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.convert import DATE_LAYOUTS, parse_layout, to_boolean, to_integer, to_moment, to_number
from ..functions.names import as_list, col, quoted, reject_ambiguous, require_columns
from ..functions.text import to_text

# Accepted spellings of the five target types.
CAST_TYPES = {
    "int": "int", "integer": "int", "int64": "int", "int32": "int",
    "float": "float", "double": "float", "float64": "float", "float32": "float",
    "bool": "bool", "boolean": "bool",
    "date": "datetime64", "datetime": "datetime64", "datetime64": "datetime64", "datetime64[ns]": "datetime64",
    "str": "str", "string": "str", "object": "str",
}


def select_columns(df: DataFrame, columns) -> DataFrame:
    """The named columns in the given order; unknown names are left out."""
    known = [c for c in as_list(columns) if c in set(df.columns)]
    if not known:
        raise ValueError(f"select: none of {columns} is a column of {df.columns}")
    return df.select(*[quoted(c) for c in known])


def cast_column(df: DataFrame, column: str, dtype: str, mode: str = "replace",
                layouts=DATE_LAYOUTS, null_text: str | None = None) -> DataFrame:
    """Convert one column; ``mode="append"`` adds ``{column}_cast`` beside it."""
    require_columns(df, [column], "cast")
    source, kind = df.schema[column].dataType, CAST_TYPES[dtype.lower()]
    value = col(column)
    if kind == "int":
        converted = to_integer(value, source)
    elif kind == "float":
        converted = to_number(value, source)
    elif kind == "bool":
        converted = to_boolean(value, source)
    elif kind == "datetime64":
        converted = to_moment(value, source, layouts)
    else:
        converted = to_text(value, source)
        if null_text is not None:
            converted = F.coalesce(converted, F.lit(null_text))
    return df.withColumn(f"{column}_cast" if mode == "append" else column, converted)


def best_layout(df: DataFrame, column: str, layouts=DATE_LAYOUTS) -> tuple[str, ...]:
    """The one layout most values follow, for ``cast_column(layouts=...)``: one small aggregate."""
    hits = [F.count(parse_layout(col(column), p)).alias(f"h{i}") for i, p in enumerate(layouts)]
    found = df.agg(*hits).first()
    best = max(range(len(layouts)), key=lambda i: (found[i], -i))
    return (layouts[best],)


def rename_columns(df: DataFrame, rename_map: dict[str, str], mode: str = "replace") -> DataFrame:
    """Rename known columns; ``mode="add"`` keeps the old ones and adds the new."""
    known = {old: new for old, new in rename_map.items() if old in set(df.columns)}
    if mode == "add":
        reject_ambiguous([*df.columns, *known.values()], "rename")
        return df.select("*", *[col(old).alias(new) for old, new in known.items()])
    reject_ambiguous([known.get(c, c) for c in df.columns], "rename")
    return df.toDF(*[known.get(c, c) for c in df.columns])
