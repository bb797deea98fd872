"""Reproducible samples and splits."""

from pyspark.sql import functions as F

from rowwright.jobs import sampling

from .registry import query


def drawn(key: str, seed) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


WEIGHTS = {"first": 0.40, "second": 0.20, "third": 0.05, "fourth": 0.15, "fifth": 0.05, "sixth": 0.15}


def weighted_sql(key: str) -> str:
    bound, lines = 0.0, []
    for name, weight in list(WEIGHTS.items())[:-1]:
        bound += weight
        lines.append(f"WHEN {drawn(key, 11)} < {int(bound / sum(WEIGHTS.values()) * 2**32)} THEN '{name}'")
    return f"CASE {' '.join(lines)} ELSE 'sixth' END"


@query(f"SELECT event_id, {weighted_sql('event_id')} AS source FROM events")
def weighted_source(t):
    return t("events").select("event_id", sampling.weighted_choice(F.col("event_id"), WEIGHTS, 11).alias("source"))


@query(f"SELECT c_custkey, c_name FROM customer ORDER BY {drawn('c_custkey', 3)}, c_custkey LIMIT 120")
def sample_rows(t):
    return sampling.sample_rows(t("customer"), "c_custkey", 120, 3).select("c_custkey", "c_name")


@query(f"""SELECT o_orderkey, (row_number() OVER (ORDER BY {drawn('o_orderkey', 5)}, o_orderkey) - 1) // 700 AS round FROM orders""")
def sample_rounds(t):
    return sampling.sample_rounds(t("orders").select("o_orderkey"), "o_orderkey", 700, 5)


JOIN_SIDES = f"""(SELECT *, {drawn('o_custkey', '7-side')} < 2147483648 AS half,
 {drawn('o_custkey', '7-both')} / 4294967296.0::DOUBLE < 1.0 / 3 AS common FROM orders)"""


@query(f"""SELECT 'left' AS side, o_custkey, count(*) AS n FROM {JOIN_SIDES} WHERE half OR common GROUP BY o_custkey
UNION ALL SELECT 'right', o_custkey, count(*) FROM {JOIN_SIDES} WHERE NOT half OR common GROUP BY o_custkey""")
def split_join_pair(t):
    left, right = sampling.split_for_join(t("orders"), "o_custkey", 7)
    sides = [df.groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
             for side, df in (("left", left), ("right", right))]
    return sides[0].unionByName(sides[1])


UNION_SIDES = f"""(SELECT *, {drawn('c_custkey', '9-base')} / 4294967296.0::DOUBLE < 0.6 AS base,
 {drawn('c_custkey', '9-both')} / 4294967296.0::DOUBLE < 0.3 AS common,
 {drawn('c_custkey', '9-c_mktsegment')} / 4294967296.0::DOUBLE >= 0.1 AS kept FROM customer)"""


@query(f"""SELECT 'left' AS side, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {UNION_SIDES} WHERE base OR common
UNION ALL SELECT 'right', c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN kept THEN c_mktsegment END FROM {UNION_SIDES} WHERE NOT base OR common""")
def split_union_pair(t):
    left, right = sampling.split_for_union(t("customer"), "c_custkey", 9, nulled=["c_mktsegment"])
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))


@query(f"""WITH e AS (SELECT event_id, 1 + user_id % 9 AS steps, CASE WHEN user_id % 9 = 0 THEN '1' WHEN user_id % 9 < 3 THEN '2-3'
 WHEN user_id % 9 < 6 THEN '4-6' ELSE '7+' END AS stratum FROM events)
SELECT event_id, steps, stratum FROM e
QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {drawn('event_id', 13)}, event_id)
 <= CASE stratum WHEN '1' THEN 90 WHEN '2-3' THEN 60 WHEN '4-6' THEN 550 ELSE 300 END""")
def stratified_quota(t):
    tasks = t("events").select("event_id", (1 + F.col("user_id") % 9).alias("steps"))
    return sampling.stratified_quota(tasks, "event_id", "steps", 1000, 13)
