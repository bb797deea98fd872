"""Run registered queries beside their SQL and compare whole results.

``python tests/oracle.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("rowwright-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def sorted_rows(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def difference(spark_df, db, sql: str) -> str | None:
    """None when both hold the same rows, else what differs."""
    expected = db.execute(sql)
    names = [d[0] for d in expected.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} instead of {sorted(names)}"
    want = sorted_rows(names, expected.fetchall())
    got = sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if want == got:
        return None
    extra, absent = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return f"{len(got)} rows instead of {len(want)}; only here {extra[:2]}; only in SQL {absent[:2]}"


def main() -> int:
    from workload import QUERIES, SQL

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark, db, bad = session(), database(folder), 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            problem = difference(df, db, SQL[name]) if name in SQL else f"(no SQL) {df.count()} rows"
        except Exception as error:  # noqa: BLE001 - every query must be reported
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None and not problem.startswith("(no SQL)")
        print(f"{name:34s} {time.time() - start:6.2f}s  {problem or 'same'}", flush=True)
    print(f"{len(names)} queries, {bad} differ")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
