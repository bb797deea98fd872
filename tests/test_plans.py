"""What the physical plans look like: pushed filters, pruned columns, no Python, no products."""

import contextlib
import io
import re

import pytest

import rowwright as rw
from workload import QUERIES, Tables

PRODUCTS = {"join_cross"}  # the caller asks for the product there
# queries whose plan ends in stored files or checkpoints are checked as far as it reaches
NAMES = sorted(QUERIES)


def plan_of(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def t(spark, folder):
    return Tables(spark, folder)


@pytest.mark.parametrize("name", NAMES)
def test_no_python_no_products_nothing_in_one_partition(spark, folder, name):
    """A single partition may receive partial aggregates or a limit, never a windowed table."""
    plan = plan_of(QUERIES[name](spark, folder))
    for operator in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct"):
        assert operator not in plan
    if name not in PRODUCTS:
        assert "BroadcastNestedLoopJoin" not in plan
    if "SinglePartition" in plan:
        windows = re.findall(r"\(\d+\) Window\n.*?\n\n", plan, re.S)
        assert not any(re.search(r"\], \[\]", w) for w in windows)
        assert "Aggregate" in plan or "Limit" in plan


def test_filters_reach_the_scan(t):
    plan = plan_of(rw.filter_rows(t("orders"), "o_totalprice > 1000 and o_orderstatus != 'P'"))
    assert "GreaterThan(o_totalprice,1000.0)" in plan
    assert "Or(Not(EqualTo(o_orderstatus,P)),IsNull(o_orderstatus))" in plan
    plan = plan_of(rw.filter_rows(t("orders"), "not (o_custkey > 5 or o_orderpriority in ['2-HIGH'])"))
    assert "LessThanOrEqual(o_custkey,5)" in plan
    assert "IsNotNull(o_custkey)" in plan_of(rw.drop_missing(t("orders"), ["o_custkey"]))


def test_chain_reads_only_what_it_needs(spark, folder):
    plan = plan_of(QUERIES["chain_sales"](spark, folder))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert sorted(schemas) == ["l_orderkey:bigint,l_quantity:double", "o_orderkey:bigint,o_totalprice:double,o_orderpriority:string"]
    assert "GreaterThan(l_quantity,20.0)" in plan and "TakeOrderedAndProject" in plan


def test_first_row_per_key_is_limited_before_the_shuffle(t):
    plan = plan_of(rw.drop_duplicates(t("events"), ["user_id"], "last", [("ts", True)]))
    assert plan.count("WindowGroupLimit") >= 2 and plan.count("Exchange") <= 4


def test_narrow_operators_do_not_shuffle(t):
    orders = t("orders")
    for df in (
        rw.unpivot_columns(orders, ["o_orderkey"], ["o_custkey", "o_totalprice"]),
        rw.wide_to_long(orders.withColumnRenamed("o_custkey", "v_1"), ["v"], ["o_orderkey"], check_unique=False),
        rw.explode_column(orders, "o_orderpriority", split_comma_text=True),
        rw.cast_column(orders, "o_totalprice", "int"), rw.drop_missing(orders), rw.select_columns(orders, ["o_custkey"]),
        rw.union_tables(orders, orders),
    ):
        assert "Exchange" not in plan_of(df)


def test_pivot_and_groupby_shuffle_partial_results_only(t):
    plan = plan_of(rw.group_rows(t("lineitem"), ["l_returnflag"], {"l_quantity": "sum", "l_tax": "mean"}))
    assert "partial_sum" in plan and plan.count(") Exchange") == 1
    plan = plan_of(rw.pivot_rows(t("lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "sum", ["F", "O"]))
    assert "partial_sum" in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_linestatus:string>" in plan


def test_equal_keys_use_hash_or_merge_joins(spark, t):
    orders, lines = t("orders"), t("lineitem")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan_of(rw.join_tables(lines, orders, "l_orderkey", "o_orderkey"))
        theta = rw.join_tables(lines, orders, on="left.l_orderkey = right.o_orderkey AND left.l_shipdate > right.o_orderdate")
        assert "SortMergeJoin" in plan_of(theta)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
