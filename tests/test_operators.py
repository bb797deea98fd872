"""Operators against the data-frame rules they follow, with gaps and a hot key."""

import random

import numpy as np
import pandas as pd
import pytest
from frames import assert_same, random_frame, rows_of, to_spark
from pyspark.sql import functions as F

import rowwright as rw

SEEDS = (1, 2, 3)

CONDITIONS = [
    "size > 2", "size != 2", "not (price > 50)", "word == 'red'", "word != 'red'", "~(word == 'red')",
    "word in ['red', 'blue']", "word not in ['red']", "not (word in ['red'])", "1 < size <= 4",
    "not (1 < price <= 40)", "price > 20 and size < 3", "price > 20 or size < 3", "not (price > 20 or size < 3)",
    "not (price > 20 and word == 'red')", "(price > 20) & (size < 3)", "(price > 20) | (size < 3)",
    "price > size * 10", "price / 2 < size + 10", "size % 3 == 1", "size // 2 == -1", "-size > 2", "price == price",
    "price != price", "price.isnull()", "price.notnull()", "not price.isnull()", "word.isin(['red', 'green'])",
    "price.between(10, 60)", "word.str.contains('re', na=False)", "word == 5", "word != 5", "size == '2'",
    "`size` >= 3", "size % (size - 1) == 0 and size > 2", "`word` == \"blue\"", "size == [1, 2]", "key == 3", "key != 3", "size ** 2 == 4",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_filter(spark, condition):
    frame = random_frame(1)
    assert_same(rw.filter_rows(to_spark(spark, frame), condition), frame.query(condition))


def test_filter_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, None)], "id int, x double")
    assert [r.id for r in rw.filter_rows(df, "x > 1").collect()] == [2]
    assert sorted(r.id for r in rw.filter_rows(df, "not (x > 1)").collect()) == [1, 3]
    assert sorted(r.id for r in rw.filter_rows(df, "x != 3").collect()) == [1, 3]


def test_filter_falls_back_to_one_comparison(spark):
    df = spark.createDataFrame([("a b", 1), ("c", 20)], "`unit name` string, `unit price` int")
    assert rw.filter_rows(df, "unit price > 3").count() == 1
    assert rw.filter_rows(df, "`unit price` > '3'").count() == 1
    assert rw.filter_rows(df, "unit name == a b").count() == 1
    assert rw.filter_rows(df, "").count() == rw.filter_rows(df, None).count() == 2
    assert rw.filter_rows(df, F.col("`unit price`") > 3).count() == 1
    for wrong in ("no such > 3", "`unit name` > 3", "unit price +", "foo(`unit price`)"):
        with pytest.raises(ValueError):
            rw.filter_rows(df, wrong)


@pytest.mark.parametrize("seed", SEEDS)
def test_groupby(spark, seed):
    frame = random_frame(seed)
    agg = {"price": "sum", "size": "mean", "id": "count"}
    assert_same(rw.group_rows(to_spark(spark, frame), ["key", "word"], agg),
                frame.groupby(["key", "word"], as_index=False).agg(agg))
    many = rw.group_rows(to_spark(spark, frame), "key", {"price": ["min", "max", "std", "var", "nunique", "avg"]})
    wanted = frame.groupby("key").agg({"price": ["min", "max", "std", "var", "nunique", "mean"]})
    wanted.columns = [f"price_{f}" for f in ("min", "max", "std", "var", "nunique", "avg")]
    assert_same(many, wanted.reset_index())
    with pytest.raises(ValueError):
        rw.group_rows(to_spark(spark, frame), ["key"], {"key": "sum"})


@pytest.mark.parametrize("ascending", [[True, False], [False, True], [True]])
def test_sort_puts_missing_last(spark, ascending):
    frame = random_frame(2)
    got = [r.id for r in rw.sort_rows(to_spark(spark, frame), ["price", "id"], ascending).collect()]
    flags = ascending if len(ascending) == 2 else True
    assert got == frame.sort_values(["price", "id"], ascending=flags)["id"].tolist()
    nan = spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, 1.0)], "id int, x double")
    assert [r.id for r in rw.sort_rows(nan, "x", False).collect()] == [2, 3, 1]


@pytest.mark.parametrize("aggfunc", ["mean", "sum", "max", "min", "count"])
@pytest.mark.parametrize("seed", SEEDS)
def test_pivot(spark, aggfunc, seed):
    frame = random_frame(seed, 40)
    frame.loc[frame["word"] == "green", "price"] = np.nan  # a column without results
    frame.loc[frame["key"] == 1, "price"] = np.nan  # a row without results
    wanted = pd.pivot_table(frame, index="key", columns="word", values="price", aggfunc=aggfunc).reset_index()
    assert_same(rw.pivot_rows(to_spark(spark, frame), "key", "word", "price", aggfunc), wanted)


def test_pivot_names_and_limits(spark):
    frame = random_frame(1)
    got = rw.pivot_rows(to_spark(spark, frame), ["word"], ["size"], ["id"], "max")
    wanted = pd.pivot_table(frame, index="word", columns="size", values="id", aggfunc="max").reset_index()
    assert got.columns == [str(c) for c in wanted.columns]
    assert_same(got, wanted)
    given = rw.pivot_rows(to_spark(spark, frame), "word", "size", "id", "max", pivot_values=[1, 2])
    assert given.columns == ["word", "1", "2"]


@pytest.mark.parametrize("values", [["price", "size"], ["word", "size"], ["size"], ["word", "price", "key"]])
def test_unpivot(spark, values):
    frame = random_frame(3)
    wanted = frame.melt(id_vars=["id"], value_vars=values)
    wanted["value"] = wanted["value"].astype("string")
    assert_same(rw.unpivot_columns(to_spark(spark, frame), ["id"], values), wanted)


def test_explode(spark):
    frame = pd.DataFrame({"id": [1, 2, 3, 4], "text": ["a, b", "", None, "c"]})
    df = to_spark(spark, frame, "id bigint, text string")
    split = frame.assign(text=frame["text"].map(lambda x: x.split(",") if isinstance(x, str) else [x])).explode("text")
    assert_same(rw.explode_column(df, "text", split_comma_text=True), split)
    words = frame.assign(text=frame["text"].map(lambda x: x.split() if isinstance(x, str) else [x])).explode("text")
    assert_same(rw.explode_column(df, "text"), words)
    lists = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id int, items array<int>")
    assert rows_of(rw.explode_column(lists, "items"))[1] == rows_of(
        pd.DataFrame({"id": [1, 1, 2, 3], "items": [1, 2, None, None]}))[1]
    literals = spark.createDataFrame(
        [(1, "['a', 'b']"), (2, "[1, 2.5]"), (3, "7"), (4, "'x'"), (5, None), (6, "(1, 2)"), (7, "[]")], "id int, q string")
    got = [tuple(r) for r in rw.explode_column(literals, "q").orderBy("id", "q").collect()]
    assert got == [(1, "a"), (1, "b"), (2, "1"), (2, "2.5"), (3, "7"), (4, "x"), (5, None), (6, "1"), (6, "2"), (7, None)]
    unicode_blanks = spark.createDataFrame([("a b　c\x1cd\te",)], "t string")
    assert [r.t for r in rw.explode_column(unicode_blanks, "t").collect()] == "a b　c\x1cd\te".split()
    with pytest.raises(ValueError):
        rw.explode_column(lists, "items", split_comma_text=True)


def test_wide_to_long(spark):
    frame = pd.DataFrame({"id": [1, 2], "note": ["x", None], "a_1": [1, 2], "a_2": [1.5, None], "b_2": ["p", "q"]})
    wanted = pd.wide_to_long(frame, ["a", "b"], i=["id"], j="n", sep="_", suffix=r"\d+").reset_index()
    for name in ("a", "b"):
        wanted[name] = wanted[name].astype("string")
    df = to_spark(spark, frame, "id bigint, note string, a_1 bigint, a_2 double, b_2 string")
    got = rw.wide_to_long(df, ["a", "b"], ["id"], "n")
    assert got.columns == list(wanted.columns)
    assert_same(got, wanted)
    with pytest.raises(ValueError, match="identify"):
        rw.wide_to_long(df.union(df), ["a"], ["id"])
    assert rw.wide_to_long(df.union(df), ["a"], ["id"], check_unique=False).count() == 8


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("hot_keys", ["adaptive", "split"])
@pytest.mark.parametrize("seed", SEEDS)
def test_join(spark, how, hot_keys, seed, monkeypatch):
    monkeypatch.setattr("rowwright.operators.combine.HOT_ROWS", 0)
    left, right = random_frame(seed, 40), random_frame(seed + 10, 12)
    right = right[right["key"] != 2].rename(columns={"size": "depth"})
    frames = to_spark(spark, left), to_spark(spark, right, "id bigint, key double, word string, price double, depth bigint")
    got = rw.join_tables(*frames, "key", "key", how, hot_keys=hot_keys)
    wanted = left.merge(right, left_on="key", right_on="key", how=how, suffixes=("_x", "_y"))
    assert got.columns == list(wanted.columns)
    assert_same(got, wanted)
    other = rw.join_tables(*frames, "size", "depth", how, ("_left", "_right"), hot_keys=hot_keys)
    wanted = left.merge(right, left_on="size", right_on="depth", how=how, suffixes=("_left", "_right"))
    assert other.columns == list(wanted.columns)
    assert_same(other, wanted)


def test_join_keys_of_different_kinds(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k bigint")
    b = spark.createDataFrame([("1", "x"), ("2.0", "y"), (None, "z")], "k string, v string")
    assert sorted(str(tuple(r)) for r in rw.join_tables(a, b, "k", "k").collect()) == ["('1', 'x')", "(None, 'z')"]
    c = spark.createDataFrame([(1.0,), (2.0,)], "k double")
    assert rw.join_tables(a, c, "k", "k").count() == 0
    d = spark.createDataFrame([(1,)], "k int")
    assert rw.join_tables(a, d, "k", "k").count() == 1
    assert rw.join_tables(a, b, "k", "k", match_nulls=False).count() == 1
    with pytest.raises(ValueError):
        rw.join_tables(a, b)


@pytest.mark.parametrize("how", ["all", "distinct"])
def test_union(spark, how):
    left = random_frame(1)[["id", "word", "size"]]
    right = pd.concat([left.head(5), random_frame(2)[["word", "size", "id"]]])[["word", "id"]]
    got = rw.union_tables(to_spark(spark, left, "id bigint, word string, size bigint"),
                          to_spark(spark, right, "word string, id bigint"), how)
    wanted = pd.concat([left, right], axis=0, ignore_index=True)
    assert_same(got, wanted.drop_duplicates() if how == "distinct" else wanted)


def test_transpose(spark):
    frame = pd.DataFrame({"metric": ["a", "b", "c"], "x": [1, 2, 3], "y": ["p", None, "r"]})
    df = to_spark(spark, frame, "metric string, x bigint, y string")
    got = rw.transpose_table(df)
    assert got.columns == ["metric", "a", "b", "c"]
    assert sorted(tuple(r) for r in got.collect()) == [("x", "1", "2", "3"), ("y", "p", None, "r")]
    again = rw.transpose_table(got, headers=["x", "y"])
    assert_same(again, frame.assign(x=frame["x"].astype(str)))
    for bad in ([("a", 1), ("a", 2)], [("a", 1), (None, 2)]):
        with pytest.raises(ValueError):
            rw.transpose_table(spark.createDataFrame(bad, "m string, x int"))


@pytest.mark.parametrize("how", ["any", "all"])
@pytest.mark.parametrize("subset", [None, ["word", "price"], ["key"]])
def test_dropna(spark, how, subset):
    frame = random_frame(2)
    assert_same(rw.drop_missing(to_spark(spark, frame), subset, how), frame.dropna(subset=subset, how=how))


@pytest.mark.parametrize("keep", ["first", "last"])
@pytest.mark.parametrize("subset", [["word"], ["key", "word"], None])
def test_deduplicate(spark, keep, subset):
    frame = random_frame(3)
    frame = frame if subset else frame[["key", "word", "size"]]
    schema = "id bigint, key double, word string, price double, size bigint" if subset else "key double, word string, size bigint"
    got = rw.drop_duplicates(to_spark(spark, frame, schema).repartition(5), subset, keep,
                             [("id", True)] if subset else None)
    assert_same(got, frame.drop_duplicates(subset=subset, keep=keep))


def test_name_clashes_are_refused(spark):
    df = to_spark(spark, random_frame(1))
    for clash in (
        lambda: rw.unpivot_columns(df, ["id"], ["size"], "id"),
        lambda: rw.unpivot_columns(df, ["id"], ["size"], "x", "X"),
        lambda: rw.group_rows(df.withColumnRenamed("word", "size_sum"), ["size_sum"], {"size": ["sum"]}),
        lambda: rw.wide_to_long(df.withColumnRenamed("size", "price_1"), ["price"], ["id"]),
        lambda: rw.rename_columns(df, {"id": "Word"}, mode="add"),
    ):
        with pytest.raises(ValueError, match="duplicate"):
            clash()


def test_topk_select_rename(spark):
    df = to_spark(spark, random_frame(1))
    assert [r.id for r in rw.top_rows(df, 3, [("id", False)]).collect()] == [59, 58, 57]
    assert rw.top_rows(df, 4).count() == 4
    assert rw.select_columns(df, ["size", "nope", "id"]).columns == ["size", "id"]
    with pytest.raises(ValueError):
        rw.select_columns(df, ["nope"])
    assert rw.rename_columns(df, {"id": "a b.c", "nope": "x"}).columns[0] == "a b.c"
    assert rw.rename_columns(df, {"id": "key", "key": "id"}).columns[:2] == ["key", "id"]
    with pytest.raises(ValueError):
        rw.rename_columns(df, {"id": "KEY"})


def numeric(series):
    return pd.to_numeric(series, errors="coerce")


def test_cast(spark):
    texts = ["5", " 7 ", "2.7", "-1.7", "zz", "", "1e3", "1d", None, "9007199254740993", "True", "FALSE"]
    frame = pd.DataFrame({"id": range(len(texts)), "t": texts})
    df = to_spark(spark, frame, "id bigint, t string")
    got = [r.t for r in rw.cast_column(df, "t", "int").orderBy("id").collect()]
    assert got == [5, 7, 2, -1, 0, 0, 1000, 0, 0, 9007199254740993, 0, 0]
    assert_same(rw.cast_column(df, "t", "float"), frame.assign(t=numeric(frame["t"])))
    got = [r.t for r in rw.cast_column(df, "t", "bool").orderBy("id").collect()]
    assert got == [False] * 10 + [True, False]
    assert [r.t for r in rw.cast_column(df, "t", "str", null_text="nan").orderBy("id").collect()][8] == "nan"
    assert rw.cast_column(df, "t", "float64", mode="append").columns == ["id", "t", "t_cast"]

    numbers = spark.createDataFrame([(1, 0.0), (2, None), (3, -2.5), (4, float("inf"))], "id int, x double")
    assert [r.x for r in rw.cast_column(numbers, "x", "bool").orderBy("id").collect()] == [False, True, True, True]
    assert [r.x for r in rw.cast_column(numbers, "x", "int").orderBy("id").collect()] == [0, 0, -2, 0]


def test_cast_moments(spark):
    texts = ["2020-01-02", "2020-01-02 03:04:05", "01/02/2020", "Jan 2, 2020", "20200102", "soon", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [str(r.t) for r in rw.cast_column(df, "t", "datetime64").orderBy("id").collect()]
    day = "2020-01-02 00:00:00"
    assert got == [day, "2020-01-02 03:04:05", day, day, day, "None", "None"]
    nanos = spark.createDataFrame([(1577934245000000000,), (-1000,)], "n bigint")
    got = [r.n for r in rw.cast_column(nanos, "n", "datetime64").collect()]
    assert got == [pd.to_datetime(1577934245000000000).to_pydatetime(), pd.to_datetime(-1000).to_pydatetime()]
    assert [r.n for r in rw.cast_column(rw.cast_column(nanos, "n", "datetime"), "n", "int").collect()] == [1577934245000000000, -1000]
    assert rw.best_layout(df, "t", ("MM/dd/yyyy", "yyyyMMdd")) == ("MM/dd/yyyy",)


def test_number_text(spark):
    values = [0.0, -0.0, 1.0, 2.5, -3.25, 1e-3, 1.5e-4, 1e-4, 9.99e-5, 1e-5, 1.25e-10, 1e7, 12345678.9, 123456789012.5,
              9999999999999998.0, 1e16, 1.5e16, 1e22, 1e100, -1e16, -12345678.9, 0.1, 1 / 3, float("inf"), float("-inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")
    got = [r.x for r in rw.cast_column(df, "x", "str").orderBy("id").collect()]
    assert got == pd.Series(values).astype(str).tolist()


def test_decimals_keep_their_digits(spark):
    df = spark.sql("SELECT 1 AS k, CAST('9007199254740993.01' AS decimal(20, 2)) AS d")
    total = rw.group_rows(df, "k", {"d": "sum"})
    assert str(total.first().d) == "9007199254740993.01"
    assert rw.cast_column(df, "d", "int").first().d == 9007199254740993
    other = spark.sql("SELECT 2 AS k, CAST('0.125' AS decimal(5, 3)) AS d")
    assert {str(r.d) for r in rw.union_tables(df, other).collect()} == {"9007199254740993.010", "0.125"}


def test_nan_is_null_where_rows_are_compared(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None), (2, 0.5)], "a int, b double")
    assert rw.drop_duplicates(df).count() == rw.drop_duplicates(df, ["b"]).count() == 2
    assert rw.union_tables(df, df, how="distinct").count() == 2


def test_given_pivot_values_are_read_by_type(spark):
    df = spark.createDataFrame([("r", 1.0, 5), ("r", 2.0, 7), ("s", 3.0, 9)], "i string, c double, v int")
    got = rw.pivot_rows(df, "i", "c", "v", "sum", pivot_values=[1, 2])
    assert got.columns == ["i", "1.0", "2.0"] and [tuple(r) for r in got.collect()] == [("r", 5, 7)]


@pytest.mark.parametrize("text, kept", [("n != 2 AND w LIKE 'r%'", [1, None]), ("n == 2 AND w LIKE 'r%'", [2]), ("n > 1 AND w LIKE 'r%'", [2])])
def test_a_condition_of_several_parts_is_not_one_comparison(spark, text, kept):
    df = spark.createDataFrame([(1, "red"), (None, "red"), (2, "red"), (1, "blue")], "n int, w string")
    assert [r.n for r in rw.filter_rows(df, text).collect()] == kept


@pytest.mark.parametrize("text, kept", [
    ("n <> 1", [None, 2, None]), ("NOT n = 1", [None, 2, None]), ("n IS NOT NULL AND w = 'it''s'", [2]),
    ("n NOT BETWEEN 1 AND 1 AND w NOT LIKE 'b%'", [None, 2, None]), ("w IN ('red') OR n IS NULL", [1, None, None]),
    ("`n` in (2) or w rlike '^b.*e$'", [1, 2]), ("length(w) > 3 AND n <> 1", [2])])
def test_sql_words_follow_the_same_rules(spark, text, kept):
    df = spark.createDataFrame([(1, "red"), (1, "blue"), (None, "red"), (2, "it's"), (None, None)], "n int, w string")
    assert [r.n for r in rw.filter_rows(df, text).collect()] == kept


def test_single_comparison_with_odd_names(spark):
    df = spark.createDataFrame([(1, "a b"), (5, "c")], "`unit price` int, w string")
    assert rw.filter_rows(df, "unit price > 3").count() == rw.filter_rows(df, "w == a b").count() == 1


def test_joins_on_ranges_are_the_plain_joins(spark):
    rng = random.Random(2)

    def value():
        odd = [None, 0.0, 8.0, 16.0, 64.0, float("inf"), float("-inf"), float("nan")]
        return rng.choice(odd) if rng.random() < 0.2 else round(rng.choice([20, 2000]) * rng.uniform(-1, 1), 1)

    left = spark.createDataFrame([(i, value(), value()) for i in range(90)], "id int, p double, q double")
    rows = [(i, value(), value()) for i in range(90)] + [(100 + i, float(i), float(i + rng.choice([0, 1, 8, 64]))) for i in range(30)]
    right = spark.createDataFrame(rows, "id int, lo double, hi double")
    for n, condition in enumerate(["x.p >= y.lo AND x.p < y.hi", "x.p between y.lo and y.hi", "x.p <= y.hi AND x.q >= y.lo",
                                   "y.lo <= x.p and x.q <= y.hi and x.id > y.id", "y.lo - 1 < p AND lo + 1 > x.p"]):
        for how in ("inner", "left", "right", "outer")[n % 2::2]:
            got = rw.join_tables(left, right, on=condition, how=how, names=("x", "y"))
            want = left.alias("x").join(right.alias("y"), F.expr(condition), how)
            assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect()))), condition
            assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    one_sided = rw.join_tables(left, right, on="x.p >= y.lo", names=("x", "y"))
    assert one_sided.count() == left.join(right, left.p >= right.lo).count()
    assert rw.join_tables(left.limit(0), right, on="x.p between y.lo and y.hi", how="outer", names=("x", "y")).count() == right.count()


def test_outer_joins_on_ranges_store_no_pairs(spark, monkeypatch):
    from rowwright.operators import ranges
    stored = []
    monkeypatch.setattr(ranges, "cut_lineage", lambda df: stored.append(df.count()) or df.localCheckpoint())
    left = spark.range(200).select(F.col("id").alias("i"), F.lit(0.0).alias("p"))
    right = spark.range(150).select(F.col("id").alias("j"), F.lit(-1.0).alias("lo"), F.when(F.col("id") != 3, 1.0).alias("hi"))
    got = rw.join_tables(left, right, on="x.p >= y.lo AND x.p < y.hi", how="outer", names=("x", "y"))
    assert got.count() == 200 * 149 + 1
    assert sum(stored) == 350


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_a_heavy_bucket_of_a_range_join_is_cut_into_tiles(spark, monkeypatch, how):
    from rowwright.operators import ranges
    monkeypatch.setattr(ranges, "HEAVY", 500)
    monkeypatch.setattr(ranges, "TILE", (16, 8))
    # one bucket holds nearly all rows; some come twice, some have no end, some meet nothing
    left = spark.range(120, numPartitions=1).select((F.col("id") % 100).alias("i"), F.expr("case when id % 11 <> 3 then 10.0D + id % 40 / 10 when id % 2 = 0 then 500.0D end").alias("p"))
    right = spark.range(60, numPartitions=1).select((F.col("id") % 50).alias("j"), F.expr("11.0D + id % 3").alias("lo"), F.expr("case when id % 7 <> 2 then 12.5D + id % 5 end").alias("hi"))
    condition = "x.p >= y.lo AND x.p < y.hi"
    got = rw.join_tables(left, right, on=condition, how=how, names=("x", "y"))
    want = left.alias("x").join(right.alias("y"), F.expr(condition), how)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    if how == "inner":
        assert got.select(F.spark_partition_id()).distinct().count() > 2


def test_rows_beyond_all_spans_of_a_level_are_in_none_of_its_buckets(spark):
    from rowwright.operators import ranges
    left = spark.range(1000).select("id", (F.col("id") * 1.0).alias("p")).alias("x")
    right = spark.range(20).select(F.expr("500.0D + id").alias("lo"), F.expr("505.0D + id + if(id = 3, 70, 0)").alias("hi")).alias("y")
    ends = ranges.bounds(left, right, "x.p >= y.lo AND x.p < y.hi", ("x", "y"))
    (visiting, _), = ranges._meetings(left, right, ends, ({"l0": "x.id", "l1": "x.p"}, {"r0": "y.lo", "r1": "y.hi"}))
    seen = {(r["__at"], r.l0) for r in visiting.select("__at", "l0").collect()}
    assert seen == {(1, i) for i in range(500, 525)} | {(3, i) for i in range(503, 579)}
