"""Chains of several steps and tables."""

from pyspark.sql import functions as F

import rowwright as rw

from .registry import cents, from_cents, query

JOINED = "table_1_table_2_join"
SALES_CHAIN = [
    {"op": "filter", "params": {"condition": "`l_quantity` > 20"}, "op_tables": ["table_1"]},
    {"op": "join", "params": {"left_on": "l_orderkey", "right_on": "o_orderkey", "how": "inner"},
     "op_tables": ["table_1", "table_2"]},
    {"op": "groupby", "params": {"by": ["o_orderpriority"], "agg": {"l_quantity": "sum", "o_totalprice": "sum"}},
     "op_tables": [JOINED]},
    {"op": "sort", "params": {"by": ["l_quantity", "o_orderpriority"], "ascending": [False, True]}, "op_tables": [JOINED]},
    {"op": "topk", "params": {"k": 3}, "op_tables": [JOINED]},
    {"op": "rename", "params": {"rename_map": {"l_quantity": "sum_qty", "o_totalprice": "sum_price"}},
     "op_tables": [JOINED]},
]


@query("""SELECT o_orderpriority, sum(l_quantity) AS sum_qty, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS sum_price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 20
GROUP BY o_orderpriority ORDER BY sum_qty DESC, o_orderpriority LIMIT 3""")
def chain_sales(t):
    orders = t("orders").withColumn("o_totalprice", cents("o_totalprice"))
    return from_cents(rw.run_chain([t("lineitem"), orders], SALES_CHAIN).result, "sum_price")


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS name, c_nationkey AS nation, c_acctbal FROM customer WHERE c_acctbal > 0),
s AS (SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nation, s_acctbal AS c_acctbal FROM supplier)
SELECT nation, count(name) AS name FROM (SELECT * FROM c UNION ALL SELECT * FROM s) GROUP BY nation""")
def chain_two_tables(t):
    both = "table_1_table_2_union"
    return rw.run_chain([t("customer"), t("supplier")], [
        {"op": "where", "params": {"condition": "c_acctbal > 0"}, "op_tables": ["table_1"]},
        {"op": "rename", "params": {"rename_map": {"c_custkey": "k", "c_name": "name", "c_nationkey": "nation"}},
         "op_tables": ["table_1"]},
        {"op": "select", "params": {"columns": ["k", "name", "nation", "c_acctbal"]}, "op_tables": ["table_1"]},
        {"op": "rename", "params": {"rename_map": {
            "s_suppkey": "k", "s_name": "name", "s_nationkey": "nation", "s_acctbal": "c_acctbal"}}, "op_tables": ["table_2"]},
        {"op": "union", "params": {"how": "all"}, "op_tables": ["table_1", "table_2"]},
        {"op": "groupby", "params": {"by": ["nation"], "agg": {"name": "count"}}, "op_tables": [both]},
    ]).result


def _with_revenue(df, price, discount):
    return df.withColumn("revenue", F.col(price) * (1 - F.col(discount)))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS revenue
FROM lineitem ORDER BY revenue DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50""")
def chain_custom_op(t):
    rw.register("with_revenue", _with_revenue, narrow=True)
    return rw.run_chain(t("lineitem"), [
        {"op": "with_revenue", "params": {"price": "l_extendedprice", "discount": "l_discount"}},
        {"op": "orderby", "params": {"by": ["revenue", "l_orderkey", "l_linenumber", "l_partkey"],
                                     "ascending": [False, True, True, True]}},
        {"op": "topk", "params": {"k": 50}},
        {"op": "select", "params": {"columns": ["l_orderkey", "l_linenumber", "l_partkey", "revenue"]}},
    ]).result


@query("""WITH f AS (SELECT user_id, event_type, ts, event_id FROM events WHERE event_type <> 'error'
 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase,
 count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS "view" FROM f GROUP BY user_id""")
def chain_latest_per_user(t):
    found = rw.run_chain(t("events"), [
        {"op": "filter", "params": {"condition": "event_type != 'error'"}},
        {"op": "sort", "params": {"by": ["ts", "event_id"]}},
        {"op": "deduplicate", "params": {"subset": ["user_id", "event_type"], "keep": "last"}},
        {"op": "pivot", "params": {"index": "user_id", "columns": "event_type", "values": "event_id", "aggfunc": "count"}},
    ]).result
    return found.na.fill(0)


# the third step of six leaves no rows; the refusal names it, and the tables tell that SQL agrees
@query("""SELECT CASE WHEN (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 20) = 0 THEN 'step 2 (join)'
 WHEN (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 20 AND o_totalprice < 0) = 0
 THEN 'step 3 (filter) leaves no rows' ELSE 'none' END AS refusal""")
def chain_refuses_empty(t):
    steps = [*SALES_CHAIN[:2], {"op": "filter", "params": {"condition": "o_totalprice < 0"}, "op_tables": [JOINED]}, *SALES_CHAIN[2:5]]
    try:
        rw.run_chain([t("lineitem"), t("orders")], steps, check_empty=True)
        refusal = "none"
    except rw.ChainError as refused:
        refusal = str(refused)
    return t.spark.range(1).select(F.lit(refusal).alias("refusal"))
