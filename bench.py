"""Headline queries, timed in a warm session; prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the local cores,
``BENCH_RUNS`` the runs per query (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload import QUERIES  # noqa: E402

HEADLINE = (
    "chain_sales", "filter_compound", "groupby_basic", "groupby_suffix_std_var_nunique", "sort_all", "pivot_sum",
    "unpivot_mixed", "explode_whitespace", "wide_to_long", "join_inner", "join_theta", "join_outer_null_keys",
    "union_distinct", "transpose_summary", "dropna_any", "dedup_keep_last", "sort_nulls_last_topk", "cast_str",
    "rename_cols", "profile_columns", "diff_tolerance", "error_types", "render_chain", "stratified_quota",
    "fk_components",
)


def seconds(name: str, spark: SparkSession, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("rowwright-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:  # warm-up: class loading and code generation
        seconds(name, spark, folder)
    found = {n: round(statistics.median(seconds(n, spark, folder) for _ in range(runs)), 4) for n in names}
    print(json.dumps({
        "metric": "headline queries, total seconds (median per query, warm session)",
        "value": round(sum(found.values()), 3), "unit": "sec", "queries": found,
        "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0),
    }))


if __name__ == "__main__":
    main()
