"""Queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its own name."""
    def enter(function: Callable[[Tables], DataFrame]):
        QUERIES[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            SQL[function.__name__] = sql.strip()
        return function
    return enter


def cents(name: str) -> Column:
    """A price in whole cents, so that sums are exact and do not depend on row order."""
    return F.rint(F.col(name) * 100).cast("bigint")


def from_cents(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(f"`{n}`") / F.lit(100.0) for n in names})


def as_double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(f"`{n}`").cast("double") for n in names})
