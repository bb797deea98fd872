"""Column names: quoting, lookup and checks against a schema."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_TYPES = (T.TimestampNTZType, T.TimestampType, T.DateType)
FRACTION_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column called exactly ``name``, dots and spaces included."""
    return F.col(quoted(name))


def as_list(value) -> list:
    if value is None:
        return []
    return list(value) if isinstance(value, (list, tuple)) else [value]


def require_columns(df: DataFrame, names: Iterable[str], where: str) -> None:
    known = set(df.columns)
    missing = [n for n in names if n not in known]
    if missing:
        raise ValueError(f"{where}: unknown columns {missing}; the table has {df.columns}")


def reject_ambiguous(names: Iterable[str], where: str) -> None:
    """Names equal up to letter case cannot be told apart by Spark's resolver."""
    counts = Counter(n.lower() for n in names)
    twice = sorted(n for n, c in counts.items() if c > 1)
    if twice:
        raise ValueError(f"{where}: duplicate column names {twice}")


def kind_of(dtype: T.DataType) -> str:
    """Coarse kind of a column: two columns of one kind compare without conversion."""
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, FRACTION_TYPES):
        return "float"
    if isinstance(dtype, TIME_TYPES):
        return "time"
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, T.ArrayType):
        return "list"
    return "other"


def is_binary_float(dtype: T.DataType) -> bool:
    """Only float and double can hold NaN."""
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_missing(column: Column, dtype: T.DataType) -> Column:
    return column.isNull() | F.isnan(column) if is_binary_float(dtype) else column.isNull()


def is_present(column: Column, dtype: T.DataType) -> Column:
    """Conjunction of plain terms, so the null test still reaches the file scan."""
    return column.isNotNull() & ~F.isnan(column) if is_binary_float(dtype) else column.isNotNull()


def nan_as_null(df: DataFrame) -> DataFrame:
    """Floats that are no number become null, so that all missing cells are one value."""
    floats = [f.name for f in df.schema.fields if is_binary_float(f.dataType)]
    return df.withColumns({n: F.when(~F.isnan(col(n)), col(n)) for n in floats}) if floats else df
