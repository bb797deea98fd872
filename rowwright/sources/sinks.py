"""Writing tables and corpora, and reading them back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import as_list, col
from .tables import MOMENT_LAYOUT, missing_as_null

TEXT_OPTIONS = {"timestampFormat": MOMENT_LAYOUT, "timestampNTZFormat": MOMENT_LAYOUT}
RECORD_OPTIONS = {**TEXT_OPTIONS, "ignoreNullFields": "false"}


def write_csv(df: DataFrame, path: str, partition_by: str | list[str] | None = None) -> None:
    """A folder of CSV parts with headers; ``partition_by`` gives one folder per
    value, its rows placed together first (large values split), so that files are few."""
    if partition_by:
        df = df.hint("rebalance", *[col(c) for c in as_list(partition_by)])
    writer = df.write.options(header=True, escape='"', **TEXT_OPTIONS)
    if partition_by:
        writer = writer.partitionBy(*as_list(partition_by))
    writer.csv(path)


def write_corpus(tasks: DataFrame, path: str) -> None:
    """Tasks as JSON lines in ``tasks``, creation time and count in ``metadata``; tasks are counted while they are written."""
    path, counted = path.rstrip("/"), Observation()
    tasks.observe(counted, F.count(F.lit(1)).alias("n")).write.options(**RECORD_OPTIONS).json(f"{path}/tasks")
    metadata = tasks.sparkSession.range(1).select(
        F.lit(counted.get["n"]).cast("bigint").alias("task_count"), F.current_timestamp().alias("creation_time"))
    metadata.write.json(f"{path}/metadata")


def write_report(rows: DataFrame, path: str) -> None:
    """Metrics, a run summary or flattened results as JSON lines."""
    rows.write.options(**RECORD_OPTIONS).json(path)


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                lines: bool = True) -> DataFrame:
    """Tasks from JSON lines, or from one ``{"metadata", "tasks"}`` document per file."""
    reader = spark.read if schema is None or not lines else spark.read.schema(schema)
    if lines:
        return reader.json(path)
    if schema is not None:
        wanted = schema.simpleString() if isinstance(schema, T.StructType) else f"struct<{schema}>"
        reader = spark.read.schema(f"tasks array<{wanted}>")
    return reader.option("multiLine", True).json(path).select(F.inline("tasks"))


def to_records(df: DataFrame) -> tuple[DataFrame, str]:
    """Rows as JSON texts, and the schema that restores types and column order."""
    texts = df.select(F.to_json(F.struct(*[col(c) for c in df.columns]), RECORD_OPTIONS).alias("record"))
    return texts, json.dumps(df.schema.jsonValue())


def from_records(records: DataFrame, schema_json: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(schema_json))
    return missing_as_null(records.select(F.from_json("record", schema, TEXT_OPTIONS).alias("r")).select("r.*"))
