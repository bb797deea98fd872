"""Filters, sorting, missing values, duplicates, columns and casts."""

from pyspark.sql import functions as F

import rowwright as rw

from .registry import cents, from_cents, query


def events_with_gaps(t):
    """Events whose type and value are missing for some rows."""
    return t("events").select(
        "event_id", "user_id", "ts",
        F.expr("nullif(event_type, 'error')").alias("kind"),
        F.expr("case when event_id % 7 <> 0 then value end").alias("amount"),
    )


GAPS = """(SELECT event_id, user_id, ts, nullif(event_type, 'error') AS kind,
 CASE WHEN event_id % 7 <> 0 THEN value END AS amount FROM events)"""


@query("SELECT * FROM orders WHERE o_totalprice >= 150000")
def filter_cmp(t):
    return rw.filter_rows(t("orders"), "`o_totalprice` >= 150000")


@query(f"SELECT event_id, kind FROM {GAPS} WHERE kind IS DISTINCT FROM 'click'")
def filter_ne_keeps_null(t):
    return rw.filter_rows(events_with_gaps(t).select("event_id", "kind"), "kind != 'click'")


@query(f"SELECT event_id, amount FROM {GAPS} WHERE amount <= 50 OR amount IS NULL")
def filter_not_keeps_null(t):
    return rw.filter_rows(events_with_gaps(t).select("event_id", "amount"), "not (amount > 50)")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders
WHERE (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000)
   OR (o_orderstatus <> 'P' AND 1000 < o_custkey AND o_custkey <= 1400)""")
def filter_compound(t):
    kept = rw.filter_rows(
        t("orders"),
        "(o_orderpriority in ['1-URGENT', '2-HIGH'] and o_totalprice > 100000)"
        " or (o_orderstatus != 'P' and 1000 < o_custkey <= 1400)",
    )
    return kept.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_extendedprice * (1 - l_discount) > 50000 AND l_quantity < l_linenumber * 10""")
def filter_arithmetic(t):
    kept = rw.filter_rows(
        t("lineitem"), "l_extendedprice * (1 - l_discount) > 50000 and l_quantity < l_linenumber * 10")
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("""SELECT doc_id, lang, n_chars FROM documents
WHERE contains(text, 'the') AND lang NOT IN ('de', 'fr')""")
def filter_text(t):
    kept = rw.filter_rows(t("documents"), "text.str.contains('the', regex=False) and lang not in ['de', 'fr']")
    return kept.select("doc_id", "lang", "n_chars")


@query("""SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderpriority LIKE '1-%' OR o_totalprice BETWEEN 1000 AND 50000""")
def filter_sql_words(t):
    kept = rw.filter_rows(t("orders"), "o_orderpriority LIKE '1-%' OR o_totalprice BETWEEN 1000 AND 50000")
    return kept.select("o_orderkey", "o_totalprice")


ORDERS_WITH_GAPS = """(SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 5 END AS n,
 CASE WHEN o_custkey % 3 <> 1 THEN o_orderpriority END AS w FROM orders)"""


# missing cells stay where a comparison is negated, whichever words say so
@query(f"""SELECT o_orderkey, n, w FROM {ORDERS_WITH_GAPS} WHERE ((n <> 2 OR n IS NULL) AND w LIKE '%-%I%')
 OR ((n NOT IN (1, 2) OR n IS NULL) AND (w NOT LIKE '1-%' OR w IS NULL) AND (n NOT BETWEEN 0 AND 3 OR n IS NULL)) OR (w IS NULL AND n = 3)""")
def filter_sql_nulls(t):
    rows = t("orders").select(
        "o_orderkey", F.expr("case when o_orderstatus <> 'P' then o_custkey % 5 end").alias("n"),
        F.expr("case when o_custkey % 3 <> 1 then o_orderpriority end").alias("w"))
    return rw.filter_rows(
        rows, "(n != 2 AND w LIKE '%-%I%') OR (n NOT IN (1, 2) AND w NOT LIKE '1-%' AND n NOT BETWEEN 0 AND 3) OR (w IS NULL AND n = 3)")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' AND year(o_orderdate) < 2000")
def filter_dates(t):
    kept = rw.filter_rows(t("orders"), "o_orderdate >= '1998-06-01' and o_orderdate.dt.year < 2000")
    return kept.select("o_orderkey", "o_orderdate")


@query("""SELECT l_returnflag, l_linestatus, avg(l_quantity) AS l_quantity,
 sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS l_extendedprice,
 max(l_discount) AS l_discount, min(l_tax) AS l_tax, count(l_orderkey) AS l_orderkey
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def groupby_basic(t):
    rows = t("lineitem").withColumn("l_extendedprice", cents("l_extendedprice"))
    return from_cents(rw.group_rows(rows, ["l_returnflag", "l_linestatus"], {
        "l_quantity": "mean", "l_extendedprice": "sum", "l_discount": "max", "l_tax": "min", "l_orderkey": "count",
    }), "l_extendedprice")


@query(f"""SELECT kind, sum(user_id)::BIGINT AS user_id, count(amount) AS amount FROM {GAPS}
WHERE kind IS NOT NULL GROUP BY kind""")
def groupby_null_key(t):
    return rw.group_rows(events_with_gaps(t), ["kind"], {"user_id": "sum", "amount": "count"})


@query("""SELECT event_type, coalesce(sum(CASE WHEN event_type <> 'error' THEN CAST(value AS DECIMAL(18,2)) END), 0)::DOUBLE AS amount
FROM events GROUP BY event_type""")
def groupby_sum_allnull(t):
    rows = t("events").select("event_type", F.when(F.col("event_type") != "error", cents("value")).alias("amount"))
    return from_cents(rw.group_rows(rows, ["event_type"], {"amount": "sum"}), "amount")


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS l_quantity_std,
 round(var_samp(l_quantity), 6) AS l_quantity_var, avg(l_quantity) AS l_quantity_avg,
 count(DISTINCT l_partkey) AS l_partkey_nunique, count(DISTINCT l_suppkey) AS l_suppkey_nunique
FROM lineitem GROUP BY l_returnflag""")
def groupby_suffix_std_var_nunique(t):
    found = rw.group_rows(t("lineitem"), ["l_returnflag"], {
        "l_quantity": ["std", "var", "avg"], "l_partkey": "nunique", "l_suppkey": "nunique"}, naming="suffix")
    return found.withColumns({n: F.round(n, 6) for n in ("l_quantity_std", "l_quantity_var")})


@query(f"SELECT event_id, amount FROM {GAPS} ORDER BY amount DESC NULLS LAST, event_id LIMIT 100")
def sort_nulls_last_topk(t):
    rows = events_with_gaps(t).select("event_id", "amount")
    return rw.top_rows(rw.sort_rows(rows, ["amount", "event_id"], [False, True]), 100)


@query(f"SELECT event_id, kind, amount FROM {GAPS}")
def sort_all(t):
    return rw.sort_rows(events_with_gaps(t).select("event_id", "kind", "amount"), ["kind", "amount", "event_id"])


@query(f"SELECT event_id, kind, amount FROM {GAPS} WHERE kind IS NOT NULL AND amount IS NOT NULL")
def dropna_any(t):
    return rw.drop_missing(events_with_gaps(t).select("event_id", "kind", "amount"))


@query(f"SELECT event_id, kind, amount FROM {GAPS} WHERE kind IS NOT NULL OR amount IS NOT NULL")
def dropna_all(t):
    return rw.drop_missing(events_with_gaps(t).select("event_id", "kind", "amount"), ["kind", "amount"], "all")


@query(f"SELECT DISTINCT user_id, kind FROM {GAPS}")
def dedup_full(t):
    return rw.drop_duplicates(events_with_gaps(t).select("user_id", "kind"))


@query(f"""SELECT event_id, user_id, kind FROM {GAPS}
QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY ts, event_id) = 1""")
def dedup_keep_first(t):
    rows = rw.drop_duplicates(events_with_gaps(t), ["user_id", "kind"], "first", [("ts", True), ("event_id", True)])
    return rows.select("event_id", "user_id", "kind")


@query(f"""SELECT event_id, user_id FROM {GAPS}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def dedup_keep_last(t):
    rows = rw.drop_duplicates(events_with_gaps(t), ["user_id"], "last", [("ts", True), ("event_id", True)])
    return rows.select("event_id", "user_id")


@query("""SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
 ORDER BY o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) = 1""")
def dedup_without_order(t):
    return rw.drop_duplicates(t("orders"), ["o_custkey"])


@query("SELECT p_size, p_brand FROM part")
def select_missing_ignored(t):
    return rw.select_columns(t("part"), ["p_size", "no such column", "p_brand"])


@query("SELECT p_partkey AS id, p_name AS \"part name\", p_size FROM part")
def rename_cols(t):
    return rw.rename_columns(t("part").select("p_partkey", "p_name", "p_size"),
                             {"p_partkey": "id", "p_name": "part name", "absent": "x"})


@query("SELECT p_partkey, p_name, p_name AS title FROM part")
def rename_add(t):
    return rw.rename_columns(t("part").select("p_partkey", "p_name"), {"p_name": "title"}, mode="add")


def events_with_texts(t):
    """Events with one text column that holds numbers, fractions, words and gaps."""
    return t("events").select("event_id", F.expr(
        "case event_id % 5 when 0 then cast(user_id as string) when 1 then '2.7' when 2 then 'zz'"
        " when 3 then concat('-', cast(value as string)) end").alias("raw"))


TEXTS = """(SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN '2.7' WHEN 2 THEN 'zz'
 WHEN 3 THEN '-' || value::VARCHAR END AS raw FROM events)"""


@query(f"SELECT event_id, coalesce(trunc(try_cast(raw AS DOUBLE)), 0)::BIGINT AS raw FROM {TEXTS}")
def cast_int(t):
    return rw.cast_column(events_with_texts(t), "raw", "int")


@query(f"SELECT event_id, try_cast(raw AS DOUBLE) AS raw FROM {TEXTS}")
def cast_float(t):
    return rw.cast_column(events_with_texts(t), "raw", "float")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, (l_extendedprice * 1000)::VARCHAR AS amount, l_quantity
FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2))::DOUBLE AS l_extendedprice, l_quantity FROM lineitem)""")
def cast_str(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                (F.col("l_extendedprice") * 1000).alias("amount"), "l_quantity")
    return rw.cast_column(rows, "amount", "str")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate END AS moment FROM orders""")
def cast_datetime(t):
    rows = t("orders").select("o_orderkey", F.expr(
        "case o_orderkey % 4 when 0 then date_format(o_orderdate, 'yyyy-MM-dd')"
        " when 1 then date_format(o_orderdate, 'MM/dd/yyyy') when 2 then date_format(o_orderdate, 'yyyyMMdd')"
        " else 'soon' end").alias("moment"))
    return rw.cast_column(rows, "moment", "datetime64")


@query(f"""SELECT event_id, coalesce(lower(kind) = 'true', false) AS kind, coalesce(amount <> 0, true) AS amount
FROM (SELECT event_id, CASE kind WHEN 'click' THEN 'True' WHEN 'view' THEN 'FALSE' ELSE kind END AS kind,
 CASE WHEN user_id % 3 = 0 THEN 0 ELSE amount END AS amount FROM {GAPS})""")
def cast_bool(t):
    rows = events_with_gaps(t).select(
        "event_id", F.expr("case kind when 'click' then 'True' when 'view' then 'FALSE' else kind end").alias("kind"),
        F.expr("case when user_id % 3 = 0 then 0D else amount end").alias("amount"))
    return rw.cast_column(rw.cast_column(rows, "kind", "bool"), "amount", "bool")


@query(f"SELECT event_id, raw, try_cast(raw AS DOUBLE) AS raw_cast FROM {TEXTS}")
def cast_append(t):
    return rw.cast_column(events_with_texts(t), "raw", "double", mode="append")
