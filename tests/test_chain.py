"""Running, checking and extending chains; narrow chains on streams."""

import json

import pytest
from frames import random_frame, to_spark
from pyspark.sql import functions as F

import rowwright as rw
from rowwright.streaming import stream_chain


def step(op, tables=("table_1",), **params):
    return {"op": op, "params": params, "op_tables": list(tables), "table_indices": [0]}


@pytest.fixture
def df(spark):
    return to_spark(spark, random_frame(1))


def test_names_and_result(spark, df):
    done = rw.run_chain([df, df, df], [
        step("filter", ["table_2"], condition="size > 0"),
        step("join", ["table_1", "table_3"], left_on="id", right_on="id", how="inner", left_table=["id"], right_table=["id"]),
        step("union", ["table_2", "table_1_table_3_join"], how="all"),
    ])
    assert list(done.tables) == ["table_2_table_1_table_3_join_union"]
    assert done.result.count() == df.filter("size > 0").count() + df.count()
    again = rw.run_chain([df, df, df], json.loads(done.to_json()))
    assert again.result.columns == done.result.columns
    assert [s["op"] for s in done.to_chain()] == ["filter", "join", "union"]
    assert done.to_chain()[1]["table_indices"] == [0, 2]


def test_aliases_export_registered_names(df):
    done = rw.run_chain(df, [step("where", condition="size > 0"), step("orderby", by=["id"]), step("astype", column="id", dtype="str")])
    assert [s["op"] for s in done.to_chain()] == ["filter", "sort", "cast"]


def test_sort_decides_what_comes_first(df):
    down = step("sort", by=["price", "id"], ascending=[False, True])
    rows = df.orderBy(F.desc_nulls_last("price"), "id").collect()
    top = rw.run_chain(df, [down, step("rename", rename_map={"price": "cost"}), step("filter", condition="size != 99"), step("topk", k=4)])
    assert [r.id for r in top.result.collect()] == [r.id for r in rows[:4]]
    kept = rw.run_chain(df, [down, step("deduplicate", subset=["word"], keep="first")]).result
    best = {}
    for r in rows:
        best.setdefault(r.word, r.id)
    assert {r.word: r.id for r in kept.collect()} == best
    dropped = rw.run_chain(df, [down, step("select", columns=["id"]), step("topk", k=4)])
    assert [r.id for r in dropped.result.collect()] == [r.id for r in rows[:4]]


@pytest.mark.parametrize("bad", [
    step("nothing"), step("filter", ["table_9"], condition="size > 0"), step("groupby", by=[], agg={"id": "sum"}),
    step("groupby", by=["id"], agg={}), step("sort"), step("sort", by=["nope"]), step("pivot", index="id", columns="word"),
    step("unpivot", id_vars=["id"]), step("explode"), step("explode", column="nope"), step("explode", column="id", split_comma=True),
    step("wide_to_long", subnames="a", i=["id"]), step("wide_to_long", subnames=["a"], i=["id"], sep=3),
    step("join", ["table_1", "table_2"], left_on="id"), step("join", ["table_1"], left_on="id", right_on="id"),
    step("union", ["table_1", "table_2"]), step("transpose", anything=1), step("dropna", how="some"), step("dropna", subset=["nope"]),
    step("deduplicate", keep="middle"), step("deduplicate", subset=["nope"]), step("topk", k=0), step("topk", k=True), step("topk"),
    step("select", columns=[]), step("cast", column="id", dtype="complex"), step("cast", column="nope", dtype="int"),
    step("rename", rename_map={"id": 3}), step("filter", condition=["x"]),
])
def test_bad_steps_are_named_before_any_job(df, bad):
    with pytest.raises(rw.ChainError, match=r"step 1 \("):
        rw.run_chain([df, df], [bad])


def test_empty_result_is_named_on_request(df):
    chain = [step("filter", condition="size > 99"), step("sort", by=["id"])]
    assert rw.run_chain(df, chain).result.isEmpty()
    with pytest.raises(rw.ChainError, match=r"step 1 \(filter\) leaves no rows"):
        rw.run_chain(df, chain, check_empty=True)
    with pytest.raises(rw.ChainError, match=r"step 2 \(sort\) leaves no rows"):
        rw.run_chain(df, chain, check_empty="end")
    assert not rw.run_chain(df, chain[1:], check_empty="end").result.isEmpty()
    with pytest.raises(ValueError, match="check_empty"):
        rw.run_chain(df, chain, check_empty="sometimes")


def test_custom_operator(df):
    rw.register("double", lambda table, column: table.withColumn(column, F.col(column) * 2), narrow=True)
    assert "double" in rw.available()
    assert rw.run_chain(df, [step("double", column="id")]).result.agg(F.sum("id")).first()[0] == 2 * sum(range(60))
    with pytest.raises(ValueError):
        rw.register("where", lambda table: table)


def test_sixteen_operators():
    builtin = {"filter", "groupby", "sort", "pivot", "unpivot", "explode", "wide_to_long", "join", "union", "transpose",
               "dropna", "deduplicate", "topk", "select", "cast", "rename"}
    assert builtin <= set(rw.available())


def test_join_condition_uses_table_names(df):
    done = rw.run_chain([df, df], [step("join", ["table_1", "table_2"], on="table_1.id = table_2.id AND table_1.size < 0")])
    assert done.result.count() == df.filter("size < 0").count()
    assert "id_x" in done.result.columns and "id_y" in done.result.columns


def test_narrow_chain_on_a_stream(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    chain = [step("filter", condition="size != 2"), step("cast", column="price", dtype="int"),
             step("unpivot", id_vars=["id"], value_vars=["price", "size"]), step("dropna"), step("rename", rename_map={"id": "key"})]
    query = (stream_chain(stream, chain).writeStream.format("memory").queryName("narrow_chain")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    batch = rw.run_chain(df, chain).result
    key = lambda r: tuple(map(str, r))
    assert sorted(spark.table("narrow_chain").collect(), key=key) == sorted(batch.collect(), key=key)
    with pytest.raises(rw.ChainError, match="whole table"):
        stream_chain(stream, [step("sort", by=["id"])])
    for open_choice in (step("explode", column="word"), step("wide_to_long", subnames=["a"], i=["id"], j="k", sep="_", suffix="x")):
        with pytest.raises(rw.ChainError, match="on a stream"):
            stream_chain(stream, [open_choice])
