"""Cell values as text, spelled as in the data frames users compare against."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import col, is_binary_float, kind_of

# Plain notation is used from 1e-4 up to 1e16, else an exponent.
PLAIN_FROM, PLAIN_BELOW = 1e-4, 1e16
JVM_PLAIN_FROM, JVM_PLAIN_BELOW = 1e-3, 1e7
PLAIN_LAYOUT = "0.0####################"


def _double_text(column: Column) -> Column:
    size = F.abs(column)
    jvm = column.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(jvm, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(jvm, r"E(-?[0-9]+)$", 1).try_cast("int")
    sign = F.when(power < 0, "-").otherwise("+")
    digits = F.lpad(F.abs(power).cast("string"), 2, "0")
    digits = F.when(F.abs(power) > 99, F.abs(power).cast("string")).otherwise(digits)
    return (
        F.when(F.isnan(column), F.lit(None))
        .when((size >= JVM_PLAIN_FROM) & (size < JVM_PLAIN_BELOW) | (size == 0), jvm)
        .when((size >= PLAIN_FROM) & (size < PLAIN_BELOW), F.call_function("format_number", column, F.lit(PLAIN_LAYOUT)))
        .when(size == float("inf"), F.when(column > 0, "inf").otherwise("-inf"))
        .otherwise(F.concat(mantissa, F.lit("e"), sign, digits))
    )


def to_text(column: Column, dtype: T.DataType) -> Column:
    """Text of a cell; null stays null."""
    if is_binary_float(dtype):
        return _double_text(column.cast("double"))
    if isinstance(dtype, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    if isinstance(dtype, T.StringType):
        return column
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def shared_text(fields: list[T.StructField]) -> dict[str, Column]:
    """Text of several columns that end up below each other in one column.

    Numbers first widen to their common type: an integer beside a fraction prints
    as ``3.0`` and a truth value beside an integer as ``1``.
    """
    kinds = {kind_of(f.dataType) for f in fields}
    if kinds <= {"int", "float", "bool"} and len(kinds) > 1:
        wide = T.DoubleType() if "float" in kinds else T.LongType()
        return {f.name: to_text(_widen(col(f.name), f.dataType, wide), wide) for f in fields}
    return {f.name: to_text(col(f.name), f.dataType) for f in fields}


def _widen(column: Column, dtype: T.DataType, wide: T.DataType) -> Column:
    return (column.cast("int") if isinstance(dtype, T.BooleanType) else column).cast(wide)
