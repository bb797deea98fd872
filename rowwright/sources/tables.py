"""Reading single tables, and cutting them to a preview size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import TIME_TYPES, as_list, col, is_binary_float, quoted, reject_ambiguous
from .records import csv_records


def missing_as_null(df: DataFrame) -> DataFrame:
    """One mark for missing values: NaN in float columns becomes null.

    Text formats get this on reading.  Columnar files keep their values, so that
    filters still reach the scan; the operators treat a NaN there as missing.
    """
    output = [
        F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name) if is_binary_float(f.dataType) else col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*output)


# Fixed value: moments are written with all their digits.
MOMENT_LAYOUT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
             index_column: bool = False, dates: bool = False, multiline: bool = False, **options) -> DataFrame:
    """CSV with a header row.

    Without a schema a pass of its own infers numbers, truth values and text; dates
    stay text, to be cast by name, unless ``dates=True``.  Name a schema for large
    files.  ``index_column`` drops the first column.  Cells that hold line breaks need
    ``multiline=True``; with a schema such files are split over tasks, too, at a shuffle of their text
    (``records.csv_records``), without one each is read by one task.
    """
    if multiline and schema is not None:
        return _read_csv_records(spark, path, schema, index_column, options)
    reader = spark.read.options(header=True, escape='"', multiLine=multiline, **options)
    if schema is None:
        found = reader.option("inferSchema", True).csv(path).schema
        schema = T.StructType([
            T.StructField(f.name, _read_type(f.dataType, dates)) for f in found.fields
        ])
    df = reader.schema(schema).csv(path)
    if index_column:
        df = df.drop(df.columns[0])
    reject_ambiguous(df.columns, "read_csv")
    return missing_as_null(df)


def _read_csv_records(spark: SparkSession, path: str | list[str], schema: T.StructType | str, index_column: bool, options: dict) -> DataFrame:
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    reject_ambiguous(schema.names, "read_csv")
    records = csv_records(spark, path).filter("NOT (block = 0 AND number = 1)")
    written = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    cells = F.from_csv("record", written, {"escape": '"', "multiLine": "true", **{k: str(v) for k, v in options.items()}})
    df = records.select(cells.alias("row")).select(*[F.col("row").getField(n).alias(n) for n in schema.names])
    return missing_as_null(df.drop(schema.names[0]) if index_column else df)


def _read_type(inferred: T.DataType, dates: bool) -> T.DataType:
    if isinstance(inferred, T.IntegralType):
        return T.LongType()
    if isinstance(inferred, T.DecimalType):
        return T.DoubleType()
    if isinstance(inferred, TIME_TYPES):
        return T.TimestampNTZType() if dates else T.StringType()
    return inferred


def read_json_records(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
                      lines: bool = True) -> DataFrame:
    """A table of JSON records.  One record per line splits over tasks; a file that is
    one JSON array (``lines=False``) is parsed by one task per file."""
    reader = spark.read.option("multiLine", not lines)
    if schema is not None:
        reader = reader.schema(schema)
    return missing_as_null(reader.json(path))


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*as_list(path))


def cap_columns(df: DataFrame, limit: int, key: str | None = None) -> DataFrame:
    """First ``limit`` columns; a join key comes first and always stays."""
    names = df.columns
    if key in names and len(names) > limit:
        names = [key] + [n for n in names if n != key]
    return df.select(*[col(n) for n in names[:limit]])


def cap_rows(df: DataFrame, limit: int, key: str) -> DataFrame:
    """The ``limit`` rows with the smallest key, a preview; ties follow the other columns."""
    if key not in df.columns:
        raise ValueError(f"no column {key!r} to choose rows by")
    rest = [n for n in df.columns if n != key]
    return df.orderBy(col(key).asc_nulls_last(), *[col(n).asc_nulls_last() for n in rest]).limit(limit)
