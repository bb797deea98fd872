"""Profiles, rules over them, and comparisons of tables."""

from pyspark.sql import functions as F

from rowwright.jobs import comparing, profiling, scoring
from rowwright.plans.registry import BUILT_IN

from .registry import query


def profile_sql(table: str, columns: dict[str, str]) -> str:
    """One line per column; ``columns`` maps a name to its kind, ``?`` for text."""
    lines = []
    for i, (name, kind) in enumerate(columns.items()):
        shown = f"CASE WHEN count(DISTINCT {name}) / count(*) < 0.5 THEN 'categorical' ELSE 'text' END" if kind == "?" else f"'{kind}'"
        commas = f"count(*) FILTER (contains({name}, ','))" if kind == "?" else "0::BIGINT"
        lines.append(
            f"SELECT '{name}' AS \"column\", {i} AS position, {shown} AS kind, count(*) AS \"rows\","
            f" count(*) - count({name}) AS nulls, count(DISTINCT {name}) AS distinct_values, {commas} AS commas FROM {table}")
    return "\nUNION ALL ".join(lines)


SHOWN = ("column", "position", "kind", "rows", "nulls", "distinct_values", "commas")


@query(profile_sql("orders", {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "?",
                              "o_totalprice": "numeric", "o_orderdate": "datetime", "o_orderpriority": "?"}))
def profile_columns(t):
    return profiling.profile_columns(t("orders")).select(*SHOWN)


@query(profile_sql("documents", {"doc_id": "numeric", "text": "?", "lang": "?", "source": "?", "n_chars": "numeric"}))
def profile_documents(t):
    return profiling.profile_columns(t("documents")).select(*SHOWN)


@query(profile_sql("(SELECT event_id, nullif(event_type, 'error') AS event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)",
                   {"event_id": "numeric", "event_type": "?", "value": "numeric"}))
def profile_with_nulls(t):
    rows = t("events").select("event_id", F.expr("nullif(event_type, 'error')").alias("event_type"),
                              F.expr("case when event_id % 7 <> 0 then value end").alias("value"))
    return profiling.profile_columns(rows).select(*SHOWN)


# forty columns in one scan
WIDE = {f"p{k}": f"l_partkey % {k + 2}" for k in range(20)}
WIDE |= {f"w{k}": f"concat('v', l_suppkey % {3 * k + 1}, ',')" for k in range(10)} | {f"o{k}": f"nullif(l_orderkey % {7 * k + 5}, {k})" for k in range(10)}


@query(profile_sql(f"(SELECT {', '.join(f'{v} AS {n}' for n, v in WIDE.items())} FROM lineitem)",
                   {n: "?" if n[0] == "w" else "numeric" for n in WIDE}))
def profile_wide(t):
    rows = t("lineitem").select(*[F.expr(v).alias(n) for n, v in WIDE.items()])
    return profiling.profile_columns(rows).select(*SHOWN)


@query("""WITH o AS (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p,
 count(DISTINCT o_orderkey) AS k, count(*) FILTER (contains(o_orderstatus, ',') OR contains(o_orderpriority, ',')) AS commas FROM orders)
SELECT n AS n_rows, 6::BIGINT AS n_columns, 3::BIGINT AS n_numeric, (s / n < 0.5)::BIGINT + (p / n < 0.5)::BIGINT AS n_categorical,
 1::BIGINT AS n_datetime, (s / n >= 0.5)::BIGINT + (p / n >= 0.5)::BIGINT AS n_text, false AS has_lists, commas > 0 AS has_comma_text,
 false AS is_wide, n = k AND n < 10 AND commas = 0 AND n <= 3 AS can_transpose, n > 1 AS can_groupby,
 s / n < 0.5 AND p / n < 0.5 AND least(s, p) < 10 AS can_pivot, true AS castable FROM o""")
def profile_flags(t):
    orders = t("orders")
    return profiling.table_flags(profiling.profile_columns(orders), orders.columns)


CASTABLE = """(SELECT event_id, value, ts, event_type, value::VARCHAR || CASE WHEN event_id % 11 = 0 THEN 'x' ELSE '' END AS amount_text,
 event_id::VARCHAR AS id_text, '20' || lpad((event_id % 100)::VARCHAR, 2, '0') || '-01-' || lpad((1 + event_id % 28)::VARCHAR, 2, '0') || ' 00:00:' || lpad((event_id % 60)::VARCHAR, 2, '0') AS day_text FROM events)"""


@query(f"""WITH e AS {CASTABLE}
SELECT 'event_id' AS "column", unnest(['str', 'float']) AS dtype_to
UNION ALL SELECT 'value', unnest(['str', 'int'])
UNION ALL SELECT 'ts', 'str'
UNION ALL SELECT 'event_type', 'str' FROM e HAVING count(DISTINCT event_type) / count(*) < 0.5
UNION ALL SELECT 'amount_text', 'float' FROM e HAVING count(DISTINCT amount_text) / count(*) >= 0.5 AND count(try_cast(amount_text AS DOUBLE)) / count(*) > 0.8
UNION ALL SELECT 'amount_text', 'str' FROM e HAVING count(DISTINCT amount_text) / count(*) < 0.5
UNION ALL SELECT 'id_text', 'float' FROM e HAVING count(try_cast(id_text AS DOUBLE)) / count(*) > 0.8
UNION ALL SELECT 'id_text', 'datetime64' FROM e HAVING count(*) FILTER (regexp_full_match(id_text, '[0-9]{{4,6}}') AND id_text::BIGINT <= 294246) / count(*) > 0.8
UNION ALL SELECT 'day_text', 'datetime64' FROM e HAVING count(DISTINCT day_text) / count(*) >= 0.5 AND count(try_cast(day_text AS TIMESTAMP)) / count(*) > 0.8
UNION ALL SELECT 'day_text', 'str' FROM e HAVING count(DISTINCT day_text) / count(*) < 0.5""")
def castable_columns(t):
    rows = t("events").select(
        "event_id", "value", "ts", "event_type",
        F.expr("concat(cast(value as string), if(event_id % 11 = 0, 'x', ''))").alias("amount_text"),
        F.col("event_id").cast("string").alias("id_text"),
        F.expr("concat('20', lpad(event_id % 100, 2, '0'), '-01-', lpad(1 + event_id % 28, 2, '0'), ' 00:00:', lpad(event_id % 60, 2, '0'))").alias("day_text"))
    return profiling.castable_columns(profiling.profile_columns(rows))


@query("""WITH o AS (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p,
 count(*) FILTER (contains(o_orderstatus, ',') OR contains(o_orderpriority, ',')) AS commas FROM orders)
SELECT unnest(['cast', 'deduplicate', 'dropna', 'filter', 'join', 'rename', 'select', 'sort', 'topk', 'union', 'unpivot']) AS op
UNION ALL SELECT 'groupby' FROM o WHERE n > 1
UNION ALL SELECT 'explode' FROM o WHERE commas > 0
UNION ALL SELECT 'pivot' FROM o WHERE s / n < 0.5 AND p / n < 0.5 AND least(s, p) < 10""")
def compatible_ops(t):
    orders = t("orders")
    flags = profiling.table_flags(profiling.profile_columns(orders), orders.columns)
    return profiling.compatible_ops(flags, BUILT_IN)


@query("""SELECT * FROM (
 SELECT 'l_orderkey' AS "column", count(DISTINCT l_orderkey) / count(*) AS ratio FROM lineitem
 UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) / count(*) FROM lineitem
 UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) / count(*) FROM lineitem
 UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice) / count(*) FROM lineitem)
WHERE ratio > 0.2 AND ratio < 0.8""")
def split_keys(t):
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice")
    return profiling.split_keys(profiling.profile_columns(rows))


# -- comparison --------------------------------------------------------------------
def report_line(report):
    return report.agg(F.count("*").alias("failed_checks"), F.coalesce(F.sum("mismatches"), F.lit(0)).cast("bigint").alias("mismatches"))


EXACT = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate"
NUMBERS = "l_discount, l_extendedprice, l_quantity, l_tax"


def diff_sql(changed: str, column: str) -> str:
    """Rows aligned by rank in their exact group, cells outside the tolerance counted."""
    rank = f"row_number() OVER (PARTITION BY {EXACT} ORDER BY {NUMBERS}) AS rn"
    return f"""WITH a AS (SELECT *, {rank} FROM lineitem),
b AS (SELECT *, {rank} FROM (SELECT * REPLACE ({changed} AS {column}) FROM lineitem)),
m AS (SELECT count(*) AS n FROM a JOIN b USING ({EXACT}, rn)
 WHERE abs(a.{column} - b.{column}) > 1e-6 + 1e-5 * abs(b.{column}))"""


@query(diff_sql("l_extendedprice * (1 + 1e-9)", "l_extendedprice") +
       " SELECT (n > 0)::BIGINT AS failed_checks, n::BIGINT AS mismatches FROM m")
def diff_equal(t):
    rows = t("lineitem")
    noisy = rows.withColumn("l_extendedprice", F.col("l_extendedprice") * (1 + 1e-9))
    return report_line(comparing.compare_tables(rows, noisy.select(*reversed(noisy.columns))))


@query(diff_sql("l_tax + CASE WHEN l_partkey % 97 = 3 THEN 0.5 ELSE 1e-9 END", "l_tax") +
       """ SELECT 'values' AS "check", 'l_tax' AS "column", n::BIGINT AS mismatches FROM m WHERE n > 0""")
def diff_tolerance(t):
    rows = t("lineitem")
    other = rows.withColumn("l_tax", F.col("l_tax") + F.when(F.col("l_partkey") % 97 == 3, 0.5).otherwise(1e-9))
    return comparing.compare_tables(rows, other).select("check", "column", "mismatches")


# noise in two columns at once, far below the tolerance; the pairs still differ in every tenth row
@query("""SELECT 'values' AS "check", 'l_tax' AS "column", count(*) AS mismatches FROM lineitem WHERE l_orderkey % 10 = 3 HAVING count(*) > 0""")
def diff_two_noisy(t):
    rows = t("lineitem").select("l_orderkey", "l_discount", "l_tax", "l_linenumber")
    other = rows.withColumns({
        "l_discount": F.col("l_discount") + 1e-9 * (F.col("l_linenumber") % 3 - 1),
        "l_tax": F.col("l_tax") + F.when(F.col("l_orderkey") % 10 == 3, 2.0).otherwise(1e-9)})
    return comparing.compare_tables(rows.drop("l_linenumber"), other.drop("l_linenumber")).select("check", "column", "mismatches")


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders),
b AS (SELECT o_orderkey, CASE WHEN o_custkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT 'rows' AS "check", '*' AS "column", (SELECT count(*) FROM a) - (SELECT count(*) FROM b) AS mismatches
UNION ALL SELECT 'unmatched', '*', (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a))""")
def diff_mismatch(t):
    left = t("orders").select("o_orderkey", "o_orderstatus")
    right = t("orders").filter("o_orderpriority <> '5-LOW'").select("o_orderkey", F.expr(
        "case when o_custkey % 13 = 0 then 'X' else o_orderstatus end").alias("o_orderstatus"))
    return comparing.compare_tables(left, right).select("check", "column", "mismatches")


# one exact value holds a third of all rows; its numbers decide the pairs
@query("""WITH a AS (SELECT o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS rn FROM orders),
b AS (SELECT o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS rn
 FROM (SELECT o_orderstatus, CASE WHEN o_totalprice > 490000 THEN o_totalprice + 1000 ELSE o_totalprice END AS o_totalprice FROM orders))
SELECT 'values' AS "check", 'o_totalprice' AS "column", count(*) AS mismatches FROM a JOIN b USING (o_orderstatus, rn)
WHERE abs(a.o_totalprice - b.o_totalprice) > 1e-6 + 1e-5 * abs(b.o_totalprice) HAVING count(*) > 0""")
def diff_large_groups(t):
    rows = t("orders").select("o_orderstatus", "o_totalprice")
    raised = rows.withColumn("o_totalprice", F.expr("case when o_totalprice > 490000 then o_totalprice + 1000 else o_totalprice end"))
    return comparing.compare_tables(rows, raised).select("check", "column", "mismatches")


# two rows an order: the right side's cross over in one column, within the tolerance of about 1, and the other column
# tells them apart; in some orders no pairing fits
@query("""SELECT 'values' AS "check", 'y' AS "column", 2 * count(*) AS mismatches FROM orders WHERE o_custkey % 10 = 3 HAVING count(*) > 0""")
def diff_matching(t):
    def rows(*pairs):
        listed = F.array(*[F.struct((100000 + F.lit(x)).alias("x"), y.alias("y")) for x, y in pairs])
        return t("orders").select("o_orderkey", "o_custkey", F.inline(listed)).select("o_orderkey", "x", "y")

    one, two = F.lit(1.0), F.lit(2.0)
    off = F.when(F.col("o_custkey") % 10 == 3, 6.0).otherwise(1.0)
    return comparing.compare_tables(rows((0.0, one), (0.5, two)), rows((0.6, off), (0.4, two))).select("check", "column", "mismatches")


# every order is a small result table of two rows; some of them differ from their target
@query("""SELECT 'order ' || o_orderkey AS item,
 CASE WHEN o_custkey % 10 = 7 THEN 'error' WHEN o_custkey % 10 IN (1, 2, 3, 4) THEN 'partial' ELSE 'success' END AS status,
 CASE o_custkey % 10 WHEN 7 THEN 'no result' WHEN 1 THEN 'missing column price' WHEN 2 THEN 'row count mismatch: 1 instead of 2'
  WHEN 3 THEN 'column mismatch: price' WHEN 4 THEN 'column mismatch: status' END AS error FROM orders""")
def score_result_tables(t):
    rows = t("orders").select(
        F.concat(F.lit("order "), "o_orderkey").alias("item"), F.explode(F.array(F.lit(0), F.lit(1))).alias("row"),
        F.col("o_custkey") % 10, "o_orderstatus", "o_totalprice").toDF("item", "row", "kind", "status", "price")

    def cells(df, without=F.lit(False)):
        named = F.array(
            F.struct(F.lit("status").alias("column"), F.col("status").alias("value")),
            F.struct(F.lit("price").alias("column"), (F.col("price") + F.col("row")).cast("string").alias("value")))
        return df.select("item", "row", F.inline(F.when(without, F.slice(named, 1, 1)).otherwise(named)))

    made = rows.filter("kind <> 7").withColumns({
        "row": 1 - F.col("row"),  # the order of rows does not matter
        "price": F.col("price") + F.expr("case kind when 3 then 10D else 1e-8D end"),
        "status": F.expr("case kind when 4 then 'X' else status end")})
    got = cells(made.filter("not (kind = 2 and row = 0)"), without=F.col("kind") == 1)  # some results have no price
    return scoring.score_results(got, cells(rows))


# every order as a table whose columns are its parts; those of one supplier list are of one type
@query("""WITH c AS (SELECT l_orderkey AS tbl, 'p' || l_partkey AS col, min(l_linenumber) AS place, min(CASE WHEN l_suppkey % 3 = 0 THEN 'int' ELSE 'text' END) AS kind
 FROM lineitem GROUP BY ALL),
s AS (SELECT tbl, string_agg(col || ' ' || kind, ',' ORDER BY place) AS layout FROM c GROUP BY tbl)
SELECT a.tbl AS one, b.tbl AS two, count(*) AS shared, bool_and(a.kind = b.kind) AS joins, bool_and(x.layout = y.layout) AS unions
FROM c a JOIN c b ON a.col = b.col AND a.tbl < b.tbl JOIN s x ON x.tbl = a.tbl JOIN s y ON y.tbl = b.tbl
GROUP BY a.tbl, b.tbl HAVING bool_and(a.kind = b.kind) OR bool_and(x.layout = y.layout)""")
def table_pairs(t):
    catalogue = t("lineitem").groupBy(F.col("l_orderkey").alias("table"), F.concat(F.lit("p"), "l_partkey").alias("column")).agg(
        F.min("l_linenumber").alias("place"), F.min(F.expr("case when l_suppkey % 3 = 0 then 'int' else 'text' end")).alias("dtype"))
    # positions count from the first column, as in a schema; their order is all that matters
    return profiling.table_pairs(catalogue.withColumnRenamed("place", "position"))


# names of two or three words; endings behind two common beginnings make a table wide
@query("""WITH n AS (SELECT DISTINCT o_custkey AS tbl, 'b' || (o_orderkey % 3) || '_' || lower(left(o_orderpriority, 1)) || '_' || lower(o_orderstatus) AS name FROM orders),
w AS (SELECT tbl, ['b', substr(name, 2, 1), substr(name, 4, 1), substr(name, 6, 1)] AS w FROM n),
p AS (SELECT DISTINCT tbl, w[1:k] AS beginning, w[k + 1:] AS ending FROM w, (SELECT unnest([1, 2, 3]) AS k))
SELECT a.tbl AS "table", array_to_string(a.ending, '_') AS one, array_to_string(b.ending, '_') AS two, count(*) AS beginnings
FROM p a JOIN p b ON a.tbl = b.tbl AND a.beginning = b.beginning AND a.ending < b.ending GROUP BY a.tbl, a.ending, b.ending HAVING count(*) >= 2""")
def wide_name_pairs(t):
    name = F.concat_ws("_", F.concat(F.lit("b"), F.col("o_orderkey") % 3), F.lower(F.left("o_orderpriority", F.lit(1))), F.lower("o_orderstatus"))
    names = t("orders").select(F.col("o_custkey").alias("table"), name.alias("column"))
    return profiling.catalogue_name_pairs(names)
