"""One key, group or copy holds a third of all rows: results stay whole, work stays spread."""

import pytest
from pyspark.sql import functions as F

import rowwright as rw
from rowwright.functions.hashing import draw
from rowwright.functions.ranking import CHUNK, rank_by_draw, rank_by_value, rank_in_groups
from rowwright.jobs import comparing, corpus

N = 6000


@pytest.fixture(scope="module")
def skewed(spark):
    """Ids with a key that is 0 for a third of them, missing for a third, else spread."""
    return spark.range(N).select(
        "id", F.expr("case id % 3 when 0 then 0 when 1 then null else id % 500 end").alias("key"),
        F.expr("cast(id * 7919 % 1000 as double)").alias("x"))


@pytest.mark.parametrize("groups", [[], ["key"]])
def test_ranks_by_value(skewed, groups):
    got = {r.id: r["rank"] for r in rank_by_value(skewed, groups, [F.col("x"), F.col("id")], "rank", 16).collect()}
    rows = sorted(skewed.collect(), key=lambda r: (r.x, r.id))
    seen, want = {}, {}
    for r in rows:
        group = r.key if groups else None
        seen[group] = seen.get(group, 0) + 1
        want[r.id] = seen[group]
    assert got == want


@pytest.mark.parametrize("heavy_rows", [100, 1_000_000])
def test_ranks_in_groups(skewed, heavy_rows, monkeypatch):
    monkeypatch.setattr("rowwright.functions.ranking.HEAVY_ROWS", heavy_rows)
    by_value = rank_by_value(skewed, ["key"], [F.col("x"), F.col("id")], "rank", 16)
    got = rank_in_groups(skewed, ["key"], [F.col("x"), F.col("id")], "rank", ["key"])
    assert sorted(map(str, got.collect())) == sorted(map(str, by_value.collect()))


def test_ranks_by_value_of_equal_rows_are_gapless(spark):
    same = spark.range(N).select(F.lit(1).alias("g"), F.lit(2.0).alias("x"))
    ranks = rank_by_value(same, ["g"], [F.col("x")], "rank", 16)
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(1, N + 1))


def test_ranks_by_draw(skewed):
    drawn = skewed.withColumn("d", draw(F.col("id"), 1)).withColumn("kind", F.col("key").isNull())
    got = rank_by_draw(drawn, ["kind"], "d", ["id"], "rank")
    counts = {r.kind: (r.n, r.m) for r in got.groupBy("kind").agg(F.count("*").alias("n"), F.max("rank").alias("m")).collect()}
    assert counts == {True: (N // 3, N // 3), False: (N - N // 3, N - N // 3)}
    assert got.select("kind", "rank").distinct().count() == N


def test_chunks_of_a_huge_group_stay_small(skewed):
    """The ranking window sees chunks of a bounded share of the rows."""
    drawn = skewed.withColumn("d", draw(F.col("id"), 1))
    chunked = drawn.withColumn(CHUNK, F.shiftright(F.col("d") * F.lit(32).cast("bigint"), 32))
    assert chunked.groupBy(CHUNK).count().agg(F.max("count")).first()[0] < 2 * N / 32


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("small_limit", [True, False])
def test_split_join_is_the_plain_join(spark, skewed, how, small_limit, monkeypatch):
    if not small_limit:  # force the way for sides too large to broadcast
        monkeypatch.setattr("rowwright.operators.combine.BROADCAST_ROWS", 0)
    right = spark.range(100).select(F.expr("if(id = 3, null, id)").alias("key"), F.col("id").alias("right_id"))
    right = right.unionAll(spark.range(100).select(F.lit(777).cast("bigint"), F.col("id") + 1000))  # hot on one side only
    monkeypatch.setattr("rowwright.operators.combine.HOT_ROWS", 20)
    plain = rw.join_tables(skewed, right, "key", "key", how, hot_keys="adaptive")
    split = rw.join_tables(skewed, right, "key", "key", how, hot_keys="split")
    assert split.columns == plain.columns
    assert split.exceptAll(plain).count() == plain.exceptAll(split).count() == 0


def test_duplicates_of_a_hot_key(skewed):
    kept = rw.drop_duplicates(skewed.repartition(7), ["key"], "last", [("id", True)])
    best = {}
    for r in skewed.collect():
        best[r.key] = max(best.get(r.key, -1), r.id)
    assert {r.key: r.id for r in kept.collect()} == best


def test_outer_joins_split_hot_keys_unasked(spark, skewed):
    right = spark.range(300).select(F.expr("if(id = 3, null, id)").alias("key"))
    plan = lambda how: rw.join_tables(skewed, right, "key", "key", how)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan("outer") and "Union" not in plan("inner")


@pytest.mark.parametrize("heavy_rows", [100, 1_000_000])
def test_comparison_with_a_hot_group(skewed, heavy_rows, monkeypatch):
    monkeypatch.setattr("rowwright.functions.ranking.HEAVY_ROWS", heavy_rows)
    moved = skewed.withColumn("x", F.col("x") + F.when(F.col("id") % 100 == 0, 0.25).otherwise(1e-10))
    assert comparing.tables_equal(skewed.drop("id"), skewed.drop("id").repartition(9))
    report = comparing.compare_tables(skewed, moved).collect()
    assert [(r.check, r.column, r.mismatches) for r in report] == [("values", "x", N // 100)]
    assert len(report[0].samples) <= 5 and all(s.left != s.right for s in report[0].samples)


def test_preview_of_a_hot_table(skewed):
    shown = corpus.table_preview(skewed, "key", ["id"], 5)
    counts = {r.key: r["count"] for r in shown.groupBy("key").count().collect()}
    assert counts[0] == counts[None] == 5 and shown.filter("key = 0").agg(F.max("id")).first()[0] == 12
