"""Reading and writing; every round trip goes through the shared scratch folder."""

from pyspark.sql import functions as F

import rowwright as rw
from rowwright.session import scratch_path
from rowwright.sources import nested, sinks, tables

from .registry import query


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(t):
    path = scratch_path(t.spark, "csv")
    customer = t("customer")
    sinks.write_csv(customer, path)
    return tables.read_csv(t.spark, path, schema=customer.schema)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def csv_inferred_types(t):
    path = scratch_path(t.spark, "csv")
    sinks.write_csv(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"), path)
    read = tables.read_csv(t.spark, path)
    return rw.cast_column(read, "o_orderdate", "datetime64")


@query("SELECT p_name, p_size FROM part")
def csv_index_drop(t):
    path = scratch_path(t.spark, "csv")
    sinks.write_csv(t("part").select(F.col("p_partkey").alias("row"), "p_name", "p_size"), path)
    return tables.read_csv(t.spark, path, schema="row bigint, p_name string, p_size int", index_column=True)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2")
def csv_partitioned_sink(t):
    path = scratch_path(t.spark, "csv")
    sinks.write_csv(t("lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), path, partition_by="l_returnflag")
    rows = tables.read_csv(t.spark, path, schema="l_linestatus string, l_quantity double, l_returnflag string")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def json_records_table(t):
    path = scratch_path(t.spark, "json")
    supplier = t("supplier")
    supplier.write.json(path)
    return tables.read_json_records(t.spark, path, schema=supplier.schema)


@query("SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type, value FROM events")
def json_round_trip(t):
    rows = t("events").select("event_id", "ts", "user_id", F.expr("nullif(event_type, 'error')").alias("event_type"), "value")
    records, schema = sinks.to_records(rows)
    return sinks.from_records(records, schema)


@query("""SELECT item, "row"::BIGINT AS "row", "column", value FROM (
 SELECT o_orderkey::VARCHAR AS item, 0 AS "row", 'status' AS "column", o_orderstatus AS value FROM orders
 UNION ALL SELECT o_orderkey::VARCHAR, 0, 'priority', o_orderpriority FROM orders
 UNION ALL SELECT o_orderkey::VARCHAR, 1, 'status', o_custkey::VARCHAR FROM orders
 UNION ALL SELECT o_orderkey::VARCHAR, 1, 'priority', NULL FROM orders)""")
def jsonl_cells(t):
    path = scratch_path(t.spark, "jsonl")
    lines = t("orders").select(F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.struct(
            F.array(F.lit("status"), F.lit("priority")).alias("columns"),
            F.array(F.array("o_orderstatus", "o_orderpriority"),
                    F.array(F.col("o_custkey").cast("string"), F.lit(None).cast("string"))).alias("data"),
        ).alias("table"))).alias("value"))
    lines.write.text(path)
    cells = nested.read_nested_tables(t.spark, path)
    return cells.select("item", F.col("row").cast("bigint").alias("row"), "column", "value")


@query("""SELECT 'c_custkey' AS "column", count(*) AS cells, count(DISTINCT c_custkey::VARCHAR) AS distinct_values FROM customer
UNION ALL SELECT 'c_mktsegment', count(*), count(DISTINCT c_mktsegment) FROM customer
UNION ALL SELECT 'c_name', count(*), count(DISTINCT c_name) FROM customer""")
def table_folder_cells(t):
    path = scratch_path(t.spark, "folder")
    sinks.write_csv(t("customer").select("c_custkey", "c_mktsegment", "c_name"), path)
    cells = nested.read_table_folder(t.spark, path)
    return cells.groupBy("column").agg(
        F.count("*").alias("cells"), F.count_distinct("value").alias("distinct_values"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def pair_manifest_union(t):
    folder = scratch_path(t.spark, "pairs")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    sinks.write_csv(orders.filter("o_orderstatus = 'P'"), f"{folder}/first.csv")
    sinks.write_csv(orders.filter("o_orderstatus <> 'P'"), f"{folder}/second.csv")
    manifest = t.spark.range(1).select(F.lit("first.csv").alias("query_table"), F.lit("second.csv").alias("candidate_table"))
    sinks.write_csv(manifest, f"{folder}/manifest.csv")
    pair = nested.read_pair_manifest(t.spark, f"{folder}/manifest.csv").first()
    one, two = nested.read_pair(t.spark, folder, pair.query_table, pair.candidate_table)
    return rw.union_tables(one, two)


# the first 100 rows by key and the first columns: the preview is the feature, not a way to save work
@query("""SELECT c_acctbal, c_custkey, c_name FROM customer
ORDER BY c_acctbal, c_custkey, c_name LIMIT 100""")
def capped_table(t):
    return tables.cap_rows(tables.cap_columns(t("customer"), 3, key="c_acctbal"), 100, key="c_acctbal")


@query("""SELECT event_id::VARCHAR AS task_id, CASE event_type WHEN 'error' THEN 'error' ELSE 'success' END AS status,
 value AS exec_time, 2::BIGINT AS steps FROM events""")
def corpus_json(t):
    path = scratch_path(t.spark, "corpus")
    tasks = t("events").select(
        F.col("event_id").cast("string").alias("task_id"),
        F.expr("case event_type when 'error' then 'error' else 'success' end").alias("status"),
        F.col("value").alias("exec_time"),
        F.array(F.struct(F.lit("filter").alias("op")), F.struct(F.lit("sort").alias("op"))).alias("transform_chain"))
    sinks.write_corpus(tasks, path)
    stored = sinks.read_corpus(t.spark, f"{path}/tasks", schema=tasks.schema)
    return stored.select("task_id", "status", "exec_time", F.size("transform_chain").cast("bigint").alias("steps"))


@query("SELECT count(*) AS task_count FROM events")
def corpus_metadata(t):
    path = scratch_path(t.spark, "corpus")
    sinks.write_corpus(t("events").select(F.col("event_id").cast("string").alias("task_id")), path)
    return t.spark.read.schema("task_count bigint").json(f"{path}/metadata")


# texts with commas, quotes and line breaks survive the way through CSV files
@query("SELECT doc_id, text, lang FROM documents")
def csv_texts_with_line_breaks(t):
    path = scratch_path(t.spark, "csv")
    documents = t("documents").select("doc_id", "text", "lang")
    sinks.write_csv(documents, path)
    return tables.read_csv(t.spark, path, schema=documents.schema, multiline=True)


# every pair of a manifest at once, from one folder of tables
@query("""SELECT pair, side, "column", count(*) AS cells, count(DISTINCT value) AS distinct_values FROM (
 SELECT 'left.csv|right.csv' AS pair, 'query' AS side, unnest(['o_orderkey', 'o_orderpriority']) AS "column",
  unnest([o_orderkey::VARCHAR, o_orderpriority]) AS value FROM orders WHERE o_custkey % 2 = 0
 UNION ALL SELECT 'left.csv|right.csv', 'candidate', unnest(['o_orderkey', 'o_custkey']), unnest([o_orderkey, o_custkey])::VARCHAR FROM orders WHERE o_custkey % 2 = 1
 UNION ALL SELECT 'left.csv|more.csv', 'query', unnest(['o_orderkey', 'o_orderpriority']), unnest([o_orderkey::VARCHAR, o_orderpriority]) FROM orders WHERE o_custkey % 2 = 0
 UNION ALL SELECT 'left.csv|more.csv', 'candidate', unnest(['c_custkey', 'c_name']), unnest([c_custkey::VARCHAR, c_name]) FROM customer)
GROUP BY ALL""")
def pair_cells_all(t):
    folder = scratch_path(t.spark, "pairs")
    orders = t("orders")
    sinks.write_csv(orders.filter("o_custkey % 2 = 0").select("o_orderkey", "o_orderpriority"), f"{folder}/left.csv")
    sinks.write_csv(orders.filter("o_custkey % 2 = 1").select("o_orderkey", "o_custkey"), f"{folder}/right.csv")
    sinks.write_csv(t("customer").select("c_custkey", "c_name"), f"{folder}/more.csv")
    manifest = t.spark.sql("select 'left.csv' as query_table, explode(array('right.csv', 'more.csv')) as candidate_table")
    # the sink writes a table as a folder of parts, so a part's table is the folder above it
    cells = nested.read_table_folder(t.spark, [f"{folder}/{n}.csv" for n in ("left", "right", "more")])
    cells = cells.withColumn("item", F.element_at(F.split("item", "/"), 1))
    return nested.pair_cells(manifest, cells).groupBy("pair", "side", "column").agg(
        F.count("*").alias("cells"), F.count_distinct("value").alias("distinct_values"))


@query("""SELECT item, "row"::BIGINT AS "row", "column", value FROM (
 SELECT c_custkey::VARCHAR AS item, 0 AS "row", unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS "column",
  unnest([c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, NULL, c_mktsegment]) AS value FROM customer)""")
def jsonl_cells_wide(t):
    path = scratch_path(t.spark, "jsonl")
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    values = [F.lit(None).cast("string") if n == "c_acctbal" else F.col(n).cast("string") for n in names]
    lines = t("customer").select(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), F.struct(
        F.array(*[F.lit(n) for n in names]).alias("columns"), F.array(F.array(*values)).alias("data")).alias("table"))).alias("value"))
    lines.write.text(path)
    return nested.read_nested_tables(t.spark, path).select("item", F.col("row").cast("bigint").alias("row"), "column", "value")
