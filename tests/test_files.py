"""Sources and sinks on small files."""

import csv
import json
import random

import pandas as pd
import pytest
from frames import assert_same, random_frame, rows_of, to_spark
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowwright.jobs import evaluation
from rowwright.session import scratch_path, shared_folder
from rowwright.sources import nested, records, sinks, tables


def test_csv_types_follow_data_frames(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    frame = random_frame(4).assign(day="2020-01-02", flag=True)
    frame.to_csv(path, index=False)
    read = tables.read_csv(spark, path)
    assert dict(read.dtypes) == {"id": "bigint", "key": "double", "word": "string", "price": "double", "size": "bigint",
                                 "day": "string", "flag": "boolean"}
    assert_same(read, pd.read_csv(path))
    assert dict(tables.read_csv(spark, path, dates=True).dtypes)["day"] == "timestamp_ntz"
    frame.to_csv(path)
    assert tables.read_csv(spark, path, index_column=True).columns == list(frame.columns)


def test_csv_sink_round_trip_of_odd_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you'), (2, "plain"), (3, None)], "id int, t string")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"), schema=df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    broken = df.withColumn("t", F.concat(F.col("t"), F.lit("\nnext, line")))
    sinks.write_csv(broken, str(tmp_path / "lines"))
    back = tables.read_csv(spark, str(tmp_path / "lines"), schema=df.schema, multiline=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, broken.collect()))


def test_duplicate_names_are_refused(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,A\n1,2\n")
    with pytest.raises(AnalysisException, match="already exists"):
        tables.read_csv(spark, str(tmp_path / "t.csv"), schema="a int, A int")


def test_json_records(spark, tmp_path):
    records = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "array.json").write_text(json.dumps(records))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, records)))
    for name, lines in (("array.json", False), ("lines.json", True)):
        assert_same(tables.read_json_records(spark, str(tmp_path / name), lines=lines), pd.DataFrame(records))


def test_nested_tables(spark, tmp_path):
    items = [{"id": f"t{i}", "table": {"columns": [f"c{k}" for k in range(12)], "data": [[k, "x", None] + [0] * 9 for k in range(3)]}}
             for i in range(2)]
    (tmp_path / "n.jsonl").write_text("\n".join(map(json.dumps, items)))
    cells = nested.read_nested_tables(spark, str(tmp_path / "n.jsonl"))
    assert cells.count() == 2 * 3 * 12
    lines = spark.read.schema(nested.NESTED_SCHEMA.format(id="id")).json(str(tmp_path / "n.jsonl"))
    one = nested.nested_table(lines, "t1")
    assert one.columns == [f"c{k}" for k in range(12)]
    assert sorted(r.c0 for r in one.collect()) == ["0", "1", "2"]
    shown = nested.previews(cells, 2)
    assert shown.count() == 4 and all(len(r.cells) == 12 for r in shown.collect())
    with pytest.raises(ValueError):
        nested.nested_table(lines, "nope")


def test_table_folder_and_pairs(spark, tmp_path):
    (tmp_path / "tables").mkdir()
    frames = {"a.csv": pd.DataFrame({"x": [1, 2], "y": ["p", "q,r"]}), "b.csv": pd.DataFrame({"y": ["s"], "z": [5]})}
    for name, frame in frames.items():
        frame.to_csv(tmp_path / "tables" / name, index=False)
    (tmp_path / "m.csv").write_text("query_table,candidate_table\na.csv,b.csv\n")
    cells = nested.read_table_folder(spark, str(tmp_path / "tables"))
    got = sorted((r.item, r.row, r.column, r.value) for r in cells.collect())
    assert got == [("a.csv", 0, "x", "1"), ("a.csv", 0, "y", "p"), ("a.csv", 1, "x", "2"), ("a.csv", 1, "y", "q,r"),
                   ("b.csv", 0, "y", "s"), ("b.csv", 0, "z", "5")]
    manifest = nested.read_pair_manifest(spark, str(tmp_path / "m.csv"))
    assert nested.pair_cells(manifest, cells).count() == 6
    one, two = nested.read_pair(spark, str(tmp_path / "tables"), "a.csv", "b.csv")
    assert one.columns == ["x", "y"] and two.columns == ["y", "z"]


def test_wide_files_equal_names_and_blanks_in_folders(spark, tmp_path):
    for part in ("a", "b"):
        (tmp_path / part).mkdir()
        pd.DataFrame([range(13)], columns=[f"{part}{k}" for k in range(13)]).to_csv(tmp_path / part / "my table+1.csv", index=False)
    cells = nested.read_table_folder(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()
    assert {(r.item, r.row) for r in cells} == {("a/my table+1.csv", 0), ("b/my table+1.csv", 0)} and len(cells) == 26


def test_caps(spark):
    df = to_spark(spark, random_frame(1))
    assert tables.cap_columns(df, 2, key="size").columns == ["size", "id"]
    assert tables.cap_columns(df, 9, key="size").columns == df.columns
    assert [r["size"] for r in tables.cap_rows(df, 3, key="size").collect()] == sorted(random_frame(1)["size"])[:3]
    with pytest.raises(ValueError):
        tables.cap_rows(df, 3, key="nope")


def test_corpus_files(spark, tmp_path):
    task = {"task_id": "a", "status": "success", "transform_chain": [{"op": "sort", "params": {"by": ["x"]}}]}
    (tmp_path / "c.json").write_text(json.dumps({"metadata": {"task_count": 1}, "tasks": [task]}))
    schema = "task_id string, status string, transform_chain array<struct<op: string>>"
    for given in (None, schema):
        tasks = sinks.read_corpus(spark, str(tmp_path / "c.json"), given, lines=False)
        assert tasks.select("task_id", "transform_chain.op").collect()[0] == ("a", ["sort"])
    sinks.write_corpus(tasks, str(tmp_path / "out"))
    assert sinks.read_corpus(spark, str(tmp_path / "out" / "tasks"), schema).count() == 1
    assert spark.read.json(str(tmp_path / "out" / "metadata")).first().task_count == 1
    sinks.write_report(evaluation.run_summary(tasks.withColumn("exec_time", F.lit(2.0))), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().success_rate == 1.0


def test_records_keep_types_and_order(spark):
    df = spark.sql("select 2 as b, 'x' as a, timestamp_ntz'2020-01-02 03:04:05.000006' as t, array(1, null) as l, cast(null as double) as d")
    records, schema = sinks.to_records(df)
    back = sinks.from_records(records, schema)
    assert back.dtypes == df.dtypes and back.collect() == df.collect()


def test_scratch_paths_lie_in_the_shared_folder(spark):
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one != two and one.startswith(shared_folder(spark).rstrip("/"))
    assert rows_of(spark.range(2))[0] == ["id"]


def test_one_csv_file_in_many_tasks(spark, tmp_path):
    rng = random.Random(8)
    pieces = ["word", "a,b", 'say "yes"', "line\nbreak", "\n\n", "", "x" * 300, '"', "é\r\n", ","]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))), i % 7) for i in range(400)]
    rows[17] = (17, "long\n" * 2000, 3)  # covers whole blocks
    rows[18] = (18, 'quo""ted\n' * 300, 4)
    for end in ("\n", "\r\n"):
        path = tmp_path / f"one{len(end)}.csv"
        with open(path, "w", newline="", encoding="utf-8") as file:
            csv.writer(file, lineterminator=end).writerows([("id", "my text", "n"), *rows])
        held = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
        try:
            lines = records.file_lines(spark, str(path))
            assert lines.select("block").distinct().count() > 20
            got = tables.read_csv(spark, str(path), schema=T.StructType().add("id", "long").add("my text", "string").add("n", "integer"), multiline=True)
            assert sorted((r[0], r[1] or "", r[2]) for r in got.collect()) == rows
            cells = nested.read_table_folder(spark, str(path)).filter("column = 'id'").collect()
            assert sorted((r.row, int(r.value)) for r in cells) == [(i, i) for i in range(400)]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", held)
