"""Pivot, unpivot, explode, wide to long, transpose."""

from pyspark.sql import functions as F

import rowwright as rw
from rowwright.jobs.profiling import infer_wide_to_long

from .registry import as_double, cents, from_cents, query

# The order priorities of the given tables.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("SELECT o_orderstatus, " + ", ".join(
    f"sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderpriority = '{p}')::DOUBLE AS \"{p}\"" for p in PRIORITIES
) + " FROM orders GROUP BY o_orderstatus")
def pivot_sum(t):
    rows = t("orders").withColumn("o_totalprice", cents("o_totalprice"))
    return from_cents(rw.pivot_rows(rows, "o_orderstatus", "o_orderpriority", "o_totalprice", "sum"), *PRIORITIES)


GAPPY = """(SELECT user_id, event_type, CASE WHEN event_type <> 'error' AND user_id % 10 <> 0
 THEN trunc(value)::BIGINT END AS amount FROM events)"""


@query("SELECT user_id, " + ", ".join(
    f"avg(amount) FILTER (event_type = '{e}') AS \"{e}\"" for e in ("click", "purchase", "signup", "view")
) + f" FROM {GAPPY} GROUP BY user_id HAVING count(amount) > 0")
def pivot_mean_drops_empty(t):
    rows = t("events").select("user_id", "event_type", F.expr(
        "case when event_type <> 'error' and user_id % 10 <> 0 then cast(value as bigint) end").alias("amount"))
    return rw.pivot_rows(rows, ["user_id"], ["event_type"], ["amount"])


@query("""SELECT l_returnflag,
 CASE WHEN count(*) FILTER (l_linestatus = 'F') > 0 THEN count(q) FILTER (l_linestatus = 'F') END AS "F",
 CASE WHEN count(*) FILTER (l_linestatus = 'O') > 0 THEN count(q) FILTER (l_linestatus = 'O') END AS "O"
FROM (SELECT *, CASE WHEN l_returnflag <> 'A' OR l_linestatus <> 'F' THEN l_quantity END AS q FROM lineitem)
GROUP BY l_returnflag""")
def pivot_count(t):
    rows = t("lineitem").withColumn("q", F.expr(
        "case when l_returnflag <> 'A' or l_linestatus <> 'F' then l_quantity end"))
    return rw.pivot_rows(rows, "l_returnflag", "l_linestatus", "q", "count")


@query("""SELECT o_orderkey, 'o_custkey' AS field, o_custkey::DOUBLE::VARCHAR AS cell FROM orders
UNION ALL SELECT o_orderkey, 'o_totalprice', o_totalprice::VARCHAR FROM orders""")
def unpivot_mixed(t):
    return rw.unpivot_columns(t("orders"), ["o_orderkey"], ["o_custkey", "o_totalprice"], "field", "cell")


@query("""SELECT o_orderkey, 'o_orderstatus' AS variable, nullif(o_orderstatus, 'P') AS value FROM orders
UNION ALL SELECT o_orderkey, 'o_orderdate', o_orderdate::VARCHAR FROM orders
UNION ALL SELECT o_orderkey, 'o_totalprice', o_totalprice::VARCHAR FROM orders""")
def unpivot_text_keeps_null(t):
    rows = t("orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    return rw.unpivot_columns(rows, ["o_orderkey"], ["o_orderstatus", "o_orderdate", "o_totalprice"])


@query("SELECT doc_id, unnest(string_split(text, ',')) AS text FROM documents")
def explode_comma(t):
    return rw.explode_column(t("documents").select("doc_id", "text"), "text", split_comma_text=True)


@query("SELECT vec_id, unnest(embedding)::DOUBLE AS embedding FROM embeddings")
def explode_array(t):
    rows = rw.explode_column(t("embeddings").select("vec_id", "embedding"), "embedding")
    return as_double(rows, "embedding")


# blank characters are spelled out: both engines' \s knows only the first few of them
@query(r"""SELECT doc_id, word AS text FROM (SELECT doc_id, unnest(string_split_regex(text,
 '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS word FROM documents)
WHERE word <> ''""")
def explode_whitespace(t):
    return rw.explode_column(t("documents").select("doc_id", "text"), "text")


@query("SELECT event_id, unnest([user_id::VARCHAR, event_id::VARCHAR]) AS pair FROM events")
def explode_literal(t):
    rows = t("events").select("event_id", F.format_string("[%d, %d]", "user_id", "event_id").alias("pair"))
    return rw.explode_column(rows, "pair")


@query("""SELECT event_id, amount FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS amount FROM events)
UNION ALL SELECT event_id, value FROM events WHERE event_id % 7 <> 0""")
def explode_scalar_twice(t):
    rows = t("events").select("event_id", F.expr("case when event_id % 7 <> 0 then value end").alias("amount"))
    return rw.explode_column(rows, "amount")


def wide_orders(t):
    return t("orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("amt_1"),
        (F.col("o_totalprice") * 2).alias("amt_2"), F.col("o_custkey").alias("qty_1"))


@query("""SELECT o_orderkey, 1::BIGINT AS n, o_orderstatus, o_totalprice::VARCHAR AS amt, o_custkey::VARCHAR AS qty FROM orders
UNION ALL SELECT o_orderkey, 2::BIGINT, o_orderstatus, (o_totalprice * 2)::VARCHAR, NULL FROM orders""")
def wide_to_long(t):
    return rw.wide_to_long(wide_orders(t), ["amt", "qty"], ["o_orderkey"], "n")


@query("""SELECT o_orderkey, o_orderstatus, 1::BIGINT AS var, o_totalprice::VARCHAR AS amt FROM orders
UNION ALL SELECT o_orderkey, o_orderstatus, 2::BIGINT, (o_totalprice * 2)::VARCHAR FROM orders""")
def wide_to_long_inferred(t):
    rows = wide_orders(t).drop("qty_1").withColumnsRenamed({"o_orderkey": "orderkey", "o_orderstatus": "status"})
    long = rw.wide_to_long(rows, **infer_wide_to_long(rows.columns))
    return long.withColumnsRenamed({"orderkey": "o_orderkey", "status": "o_orderstatus"})


@query("""WITH s AS (SELECT l_returnflag AS f, sum(l_quantity) AS q, count(l_orderkey) AS n FROM lineitem GROUP BY 1)
SELECT 'l_quantity' AS l_returnflag, max(q) FILTER (f = 'A')::VARCHAR AS "A", max(q) FILTER (f = 'N')::VARCHAR AS "N",
 max(q) FILTER (f = 'R')::VARCHAR AS "R" FROM s
UNION ALL SELECT 'l_orderkey', max(n) FILTER (f = 'A')::VARCHAR, max(n) FILTER (f = 'N')::VARCHAR,
 max(n) FILTER (f = 'R')::VARCHAR FROM s""")
def transpose_summary(t):
    summary = rw.group_rows(t("lineitem"), ["l_returnflag"], {"l_quantity": "sum", "l_orderkey": "count"})
    return rw.transpose_table(summary)
