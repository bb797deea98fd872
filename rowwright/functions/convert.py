"""Value conversions that never fail: bad input becomes null, zero or false."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import kind_of

# Text accepted as a number, and the date layouts tried in turn.
NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
DATE_LAYOUTS = (
    "yyyy/M/d HH:mm:ss",
    "yyyy/M/d",
    "M/d/yyyy HH:mm:ss",
    "M/d/yyyy",
    "M-d-yyyy",
    "d-MMM-yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
)
LAYOUT_SHAPES = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": r"\p{L}+", "MMM": r"\p{L}+\.?",
                 "MM": r"\d{2}", "M": r"\d{1,2}", "dd": r"\d{2}", "d": r"\d{1,2}",
                 "HH": r"\d{2}", "H": r"\d{1,2}", "mm": r"\d{2}", "m": r"\d{1,2}", "ss": r"\d{2}", "s": r"\d{1,2}"}
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def to_number(column: Column, dtype: T.DataType) -> Column:
    """Double value of a cell; text that is no plain number gives null."""
    kind = kind_of(dtype)
    if kind == "text":
        value = F.when(column.rlike(NUMBER_TEXT), F.trim(column).try_cast("double"))
    elif kind == "bool":
        value = column.cast("int").cast("double")
    elif kind == "time":
        value = epoch_nanos(column).cast("double")
    else:
        value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def epoch_nanos(column: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", F.expr(EPOCH), column.cast("timestamp_ntz"))
    return micros * F.lit(1000).cast("bigint")


def to_integer(column: Column, dtype: T.DataType) -> Column:
    """Truncates toward zero; whatever is no finite number becomes 0."""
    kind = kind_of(dtype)
    zero = F.lit(0).cast("bigint")
    if kind == "int":
        return F.coalesce(column.cast("bigint"), zero)
    if kind == "time":
        return F.coalesce(epoch_nanos(column), zero)
    if isinstance(dtype, T.DecimalType):
        return F.coalesce(column.try_cast("bigint"), zero)
    truncated = to_number(column, dtype).try_cast("bigint")
    if kind != "text":
        return F.coalesce(truncated, zero)
    exact = F.when(column.rlike(INTEGER_TEXT), F.trim(column).try_cast("bigint"))
    return F.coalesce(exact, truncated, zero)


def to_boolean(column: Column, dtype: T.DataType) -> Column:
    kind = kind_of(dtype)
    if kind in ("int", "float"):
        return F.coalesce(column != 0, F.lit(True))
    if kind == "text":
        return F.coalesce(F.lower(column) == "true", F.lit(False))
    if kind == "bool":
        return F.coalesce(column, F.lit(False))
    return F.lit(True)


def layout_shape(layout: str) -> str | None:
    """Pattern of texts that can follow a layout; none for layouts with other letters."""
    pieces = re.findall(r"([A-Za-z])(\1*)|(.)", layout)
    shapes = [LAYOUT_SHAPES.get(a + b) if a else re.escape(other) for a, b, other in pieces]
    return None if None in shapes else "".join(shapes)


def parse_layout(column: Column, layout: str) -> Column:
    """Moment of a text in one layout; text of another shape is not even tried.

    A failed parse costs an exception per cell, a shape test next to nothing.
    """
    moment = F.try_to_timestamp(column, F.lit(layout)).cast("timestamp_ntz")
    shape = layout_shape(layout)
    return moment if shape is None else F.when(column.rlike(f"^{shape}$"), moment)


def to_moment(column: Column, dtype: T.DataType, layouts=DATE_LAYOUTS, iso: bool = True) -> Column:
    """Timestamp without time zone; numbers count nanoseconds from 1970."""
    kind = kind_of(dtype)
    if kind == "time":
        return column.cast("timestamp_ntz")
    if kind in ("int", "float"):
        seconds = (column.cast("decimal(38,9)") / F.lit(10**9).cast("decimal(10,0)")).cast("decimal(18,6)")
        return F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    if kind != "text":
        return F.lit(None).cast("timestamp_ntz")
    tries = [column.try_cast("timestamp_ntz")] if iso else []
    parsed = [parse_layout(column, layout) for layout in layouts]
    shapes = [layout_shape(layout) for layout in layouts]
    if parsed and None not in shapes:  # one test for all layouts spares most texts the single ones
        parsed = [F.when(column.rlike(f"^(?:{'|'.join(shapes)})$"), F.coalesce(*parsed))]
    return F.coalesce(*tries, *parsed)


def whole_below(value: Column) -> Column:
    """The greatest whole number not above a double, as a double of any size; no negative zero."""
    return F.when(F.abs(value) < 2.0**52, F.floor(value).cast("double")).otherwise(value) + F.lit(0.0)
