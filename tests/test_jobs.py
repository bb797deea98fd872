"""Profiles, comparisons, corpus jobs, samples and the key graph on small inputs."""

import itertools
import json
import random
import re

import pytest
from frames import random_frame, to_spark
from pyspark.sql import functions as F

from rowwright.functions.hashing import draw, draw_name
from rowwright.functions.ranking import rank_in_groups
from rowwright.jobs import comparing, corpus, evaluation, keygraph, matching, profiling, sampling, scoring


# -- profiles ----------------------------------------------------------------------
def test_profile_kinds(spark):
    df = spark.sql("""select id, cast(id % 2 as string) as cat, concat('t', id) as txt, id > 3 as flag, timestamp_ntz'2020-01-01' as day,
      array(id) as items, map(id, id) as m, if(id = 1, null, 'a,b') as commas, cast(id as string) as digits from range(8)""")
    rows = {r.column: r for r in profiling.profile_columns(df).collect()}
    assert {c: r.kind for c, r in rows.items()} == {
        "id": "numeric", "cat": "categorical", "txt": "text", "flag": "numeric", "day": "datetime", "items": "list",
        "m": "other", "commas": "categorical", "digits": "text"}
    assert rows["commas"].commas == 7 and rows["commas"].nulls == 1 and rows["digits"].numbers == 8
    casts = {(r.column, r.dtype_to) for r in profiling.castable_columns(profiling.profile_columns(df)).collect()}
    assert {("digits", "float"), ("id", "str"), ("id", "float"), ("day", "str"), ("cat", "str")} <= casts
    approximate = {r.column: r.kind for r in profiling.profile_columns(df, approximate=True).collect()}
    assert approximate["cat"] == "categorical" and approximate["txt"] == "text"


@pytest.mark.parametrize("rows, expected", [
    ([("a", 1), ("b", 2)], True), ([("a", 1), ("a", 2)], False), ([("1", 1), ("2", 1), ("3", 1), ("4", 1)], False),
    ([(f"r{i}", i) for i in range(10)], False), ([("a,b", 1), ("c", 2)], False),
])
def test_can_transpose(spark, rows, expected):
    df = spark.createDataFrame(rows, "metric string, v int")
    flags = profiling.table_flags(profiling.profile_columns(df), df.columns).first()
    assert flags.can_transpose is expected


def test_ops_that_fit(spark):
    def fitting(df):
        return {r.op for r in profiling.compatible_ops(profiling.table_flags(profiling.profile_columns(df), df.columns)).collect()}

    lists = spark.createDataFrame([([1],), ([2],)], "l array<int>")
    assert "explode" in fitting(lists) and not {"filter", "groupby", "pivot", "unpivot", "cast"} & fitting(lists)
    wide = spark.createDataFrame([(1, 2, 3, 4)], "a_1 int, a_2 int, b_1 int, b_2 int")
    assert {"wide_to_long", "unpivot", "cast", "filter"} <= fitting(wide)


def test_wide_names():
    assert profiling.is_wide(["a_1", "b_1", "a_2", "b_2"]) and profiling.is_wide(["x1", "y1", "x2", "y2"])
    assert not profiling.is_wide(["a_1", "b_1", "c"]) and not profiling.is_wide(["name", "age"])
    assert profiling.wide_name_pairs(["a_1", "b_1", "a_2", "b_2"]) == [("1", "2", 2)]
    found = profiling.infer_wide_to_long(["id", "sales 2019", "sales 2020", "cost 2019", "cost 2020"])
    assert found == {"subnames": ["sales", "cost"], "i": ["id"], "j": "var", "sep": " ", "suffix": r"\w+"}
    assert profiling.infer_wide_to_long(["x1", "x2", "x3", "note"]) == {
        "subnames": ["x"], "i": ["note"], "j": "var", "sep": "", "suffix": r"\w+"}
    assert profiling.infer_wide_to_long(["a_total", "b_total", "c_total", "id"])["subnames"] == ["total"]
    assert profiling.infer_wide_to_long(["a", "b"])["subnames"] == []


def test_table_pairs(spark):
    a, b = spark.sql("select 1 as k, 'x' as v"), spark.sql("select 'y' as v, 2 as k")
    c, d = spark.sql("select 1L as k"), spark.sql("select 1 as other")
    assert profiling.join_possible(a, b) and not profiling.union_possible(a, b)
    assert not profiling.join_possible(a, c) and not profiling.join_possible(a, d) and profiling.union_possible(a, a)
    found = profiling.pair_operations({"t1": a, "t2": b, "t3": d}, {"t1": "k", "t3": "other"})
    assert found == [{"op": "join", "tables": ["t1", "t2"], "on": ("k", "k")}, {"op": "join", "tables": ["t1", "t3"], "on": ("k", "other")}]


# -- comparison --------------------------------------------------------------------
def test_shuffled_copy_is_equal(spark):
    df = to_spark(spark, random_frame(1, 300))
    noisy = df.withColumn("price", F.col("price") + 1e-9).repartition(7).select("size", "price", "word", "key", "id")
    assert comparing.tables_equal(df, noisy)
    assert comparing.run_status(comparing.compare_tables(df, noisy)) == "success"
    assert comparing.run_status(comparing.compare_tables(df, df.limit(5))) == "partial"
    assert comparing.run_status(None, failed=True) == "error" and comparing.run_status(None, timed_out=True) == "timeout"


def test_noise_in_two_columns_and_a_chosen_tolerance(spark):
    a = spark.sql("select id % 7 + 0D as x, id + 0D as y from range(50)")
    b = spark.sql("select id % 7 + 1e-9 * (id % 3 - 1) as x, id + 1e-9 as y from range(50)")
    assert comparing.tables_equal(a, b)
    found = {r.column: r for r in comparing.compare_tables(a, b, tolerance=0, relative=0).collect()}
    assert found["y"].mismatches > 40 and len(found["y"].samples) == 5
    shifted = a.withColumn("y", F.col("y") + 0.25)
    assert comparing.compare_tables(a, shifted, tolerance=0.5).isEmpty() and not comparing.tables_equal(a, shifted)


def plain_missing(lefts, rights, tolerance):
    """Left rows without partner in a largest matching, by trying to move every partner."""
    taken = {}

    def place(i, seen):
        for j, (_, _, b) in enumerate(rights):
            if j not in seen and all(matching.is_close(x, y, tolerance, 0) for x, y in zip(lefts[i][2], b, strict=True)):
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False
    return sum(not place(i, set()) for i in range(len(lefts)))


def test_matching_is_largest():
    rng = random.Random(4)

    def rows():
        numbers = [[rng.choice([None, rng.uniform(0, 4)]) for _ in range(2)] for _ in range(rng.randint(0, 6))]
        return [(rng.randint(1, 3), [None if x is None else float(int(x)) for x in v], v) for v in numbers]

    for _ in range(500):
        a, b = rows(), rows()
        single = [[(1, c, v) for n, c, v in side for _ in range(n)] for side in (a, b)]
        assert matching.unmatched(a, b, 1.0, 0.0) == plain_missing(*single, 1.0)


def test_rows_that_cross_over_are_equal(spark):
    schema = "k string, x double, y double"
    left = spark.createDataFrame([("k", 100000.0, 1.0), ("k", 100000.5, 2.0), ("m", 1.0, None), ("m", None, 1.0)], schema)
    right = spark.createDataFrame([("k", 100000.6, 1.0), ("k", 100000.4, 2.0), ("m", None, 1.0), ("m", 1.0, None)], schema)
    assert comparing.tables_equal(left, right) and comparing.tables_equal(left.drop("k"), right.drop("k"))
    assert not comparing.tables_equal(left, right.withColumn("y", F.col("y") + F.when(F.col("x") > 100000.5, 3.0).otherwise(0.0)))
    # rows that are equal must not take each other's only partner
    left, right = ([("a", 0.0), ("a", x), ("b", 5.0)] for x in (-1.0, 1.0))
    pair = [spark.createDataFrame(rows, "k string, x double") for rows in (left, right)]
    assert comparing.compare_tables(*pair, tolerance=1.0, relative=0).isEmpty()
    assert not comparing.compare_tables(*pair, tolerance=0.99, relative=0).isEmpty()
    flat = [df.drop("k") for df in pair]
    assert comparing.compare_tables(*flat, tolerance=1.0, relative=0).isEmpty()


@pytest.mark.parametrize(("tolerance", "relative"), [(1e-6, 1e-5), (0.5, 0.0), (0.0, 0.01), (1e-3, 0.2)])
def test_cells_hold_and_reach_the_tolerance(spark, tolerance, relative):
    rng = random.Random(6)
    rows = []
    for _ in range(2000):
        a = rng.choice([-1, 1]) * 10 ** rng.uniform(-8, 8) * rng.choice([0, 1, 1, 1])
        rows.append((a, a + rng.uniform(-1.2, 1.2) * (tolerance + relative * abs(a))))
    cell = lambda c: matching.tolerance_cell(F.col(c), tolerance, relative)
    for r in spark.createDataFrame(rows, "a double, b double").select("a", "b", cell("a").alias("i"), cell("b").alias("j")).collect():
        if r.i == r.j:
            assert matching.is_close(r.a, r.b, tolerance, relative)
        elif matching.is_close(r.a, r.b, tolerance, relative):
            assert abs(r.i - r.j) <= matching.REACH


def report(left, right):
    return {(r.check, r.column): r.mismatches for r in comparing.compare_tables(left, right).collect()}


def test_differences_are_counted(spark):
    df = to_spark(spark, random_frame(2, 300))
    assert report(df, df.drop("word")) == {("columns", "word"): 1}
    assert report(df, df.filter("id <> 5")) == {("rows", "*"): 1, ("unmatched", "*"): 1}
    changed = df.withColumn("price", F.when(F.col("id") % 50 == 0, F.coalesce("price", F.lit(0.0)) + 1).otherwise(F.col("price")))
    assert report(df, changed) == {("values", "price"): 6}
    lost = df.withColumn("price", F.when(F.col("id") != 7, F.col("price")))
    assert report(df.fillna(1.0, "price"), lost.fillna(1.0, "price").withColumn(
        "price", F.when(F.col("id") != 7, F.col("price")))) == {("values", "price"): 1}


def test_numbers_beside_text(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "id int, x double")
    assert report(a, spark.createDataFrame([(1, "2"), (2, None)], "id int, x string")) == {}
    assert ("unmatched", "*") in report(a, spark.createDataFrame([(1, "2"), (2, "zz")], "id int, x string"))
    assert report(spark.sql("select 1 as n"), spark.sql("select 1L as n")) == {}
    assert report(spark.sql("select 1000000 as n"), spark.sql("select 1000001 as n")) == {("unmatched", "*"): 2}


def test_only_fractions_and_one_huge_group(spark):
    df = spark.range(2000).select((F.col("id") % 10 / 10).alias("x"))  # two hundred copies of each value
    assert report(df, df.repartition(5).select((F.col("x") + 1e-9).alias("x"))) == {}
    assert report(df, df.select(F.when(F.col("x") == 0.9, 5.0).otherwise(F.col("x")).alias("x"))) == {("values", "x"): 200}


def test_pairs_by_order_count_rows_that_cancel_elsewhere(spark):
    def df(values):
        return spark.createDataFrame([("k", v) for v in values] + [("other", 7.0)], "g string, x double")

    # 20 and 30 are on both sides, but by order each row meets the next one
    assert report(df([10.0, 20.0, 30.0]), df([20.0, 30.0, 40.0])) == {("values", "x"): 3}
    # copies within the tolerance of each other of which one side has more: no value stands for another
    assert report(df([100000.0, 100000.9, 100000.9]), df([99999.5, 99999.2, 99999.2])) == {("values", "x"): 2}


def test_noise_beyond_the_grid_leaves_no_rows(spark):
    df = spark.range(3000).select("id", (F.col("id") * 31.0 + 50000).alias("x"))
    other = df.withColumn("x", F.col("x") * (1 + 1e-9))
    rest, surplus = comparing._leftovers(comparing._both_sides(df, other, ["id"], {"id": "exact", "x": "number"}), ["id"], ["x"], 1e-6, 1e-5)
    assert surplus == 0 and rest.count() < 30


# -- scores and corpus -------------------------------------------------------------
def test_error_families(spark):
    cases = {"Parsing failed: wrong FORMAT": "parsing_format_error", "parse": "parsing_general_error",
             "execution: param and type": "execution_param_error", "mismatch in rows": "validation_size_error",
             "input table missing": "input_missing_error", "LLM network": "model_connection_error",
             "chain order": "chain_order_error", "disk io": "io_general_error", "hm": "unknown_error", "": "unknown_error"}
    df = spark.createDataFrame([*cases.items(), (None, "unknown_error")], "m string, want string")
    assert df.filter(evaluation.error_type(F.col("m")) != F.col("want")).count() == 0
    labels = [label for _, inner, _ in evaluation.ERROR_FAMILIES for label, _ in inner]
    labels += [other for _, _, other in evaluation.ERROR_FAMILIES]
    assert len(evaluation.ERROR_FAMILIES) == 7 and len(labels) == len(set(labels)) == 34


def test_run_summary_of_nothing(spark):
    row = evaluation.run_summary(spark.createDataFrame([], "status string, exec_time double")).first()
    assert (row.total_tasks, row.success_rate, row.total_time, row.avg_time) == (0, 0.0, 0.0, 0.0)


RENDERED = [
    'No transformation operations',
    "1. sort (by: ['a', 'b c'], ascending: [True, False]) (op_tables: table_1)",
    '1. join (left_table: table_1, right_table: table_2, how: inner, left_on: k) (op_tables: table_1, table_2)\n'
    "2. groupby (by: ['k'], agg: {'x': 'sum', 'y': 'mean'}) (op_tables: table_1_table_2_join)",
    '1. transpose (No parameters) (op_tables: No tables)\n'
    '2. dropna (subset: None, how: any) (op_tables: table_1)\n'
    '3. topk (k: 3) (op_tables: table_1)',
    r"""1. select (columns: ['2019', 'true', 2019, 1.5, True, None, "it's", 'say "x"', 'a\\b']) (op_tables: table_1)""",
]


CHAINS = [
    [],
    [{"op": "sort", "params": {"by": ["a", "b c"], "ascending": [True, False]}, "op_tables": ["table_1"]}],
    [{"op": "join", "params": {"left_table": ["x"], "right_table": ["y"], "how": "inner", "left_on": "k"}, "op_tables": ["table_1", "table_2"]},
     {"op": "groupby", "params": {"by": ["k"], "agg": {"x": "sum", "y": "mean"}}, "op_tables": ["table_1_table_2_join"]}],
    [{"op": "transpose", "params": {}, "op_tables": []}, {"op": "dropna", "params": {"subset": None, "how": "any"}, "op_tables": ["table_1"]},
     {"op": "topk", "params": {"k": 3}, "op_tables": ["table_1"]}],
    [{"op": "select", "params": {"columns": ["2019", "true", 2019, 1.5, True, None, "it's", 'say "x"', "a\\b"]}, "op_tables": ["table_1"]}],
]


def test_render_chain(spark):
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(CHAINS)], "i int, text string")
    got = df.select("i", corpus.render_chain(corpus.parse_chain(F.col("text"))).alias("lines")).orderBy("i").collect()
    assert [r.lines for r in got] == RENDERED


def test_prune_keeps_combined_and_single_tables(spark):
    df = spark.createDataFrame([(json.dumps(c), n) for c in CHAINS[1:3] for n in (1, 2)], "text string, n int")
    kept = df.select(corpus.kept_table(corpus.parse_chain(F.col("text")), F.col("n")).alias("kept")).collect()
    assert [r.kept for r in kept] == [None, 0, None, None]


def test_responses(spark):
    texts = ["a```python\nx = 1\n```b```y```", "```\nz\n```", "  plain\n", "```python\nopen end", "```one"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.c for r in df.orderBy("i").select(corpus.extract_code(F.col("t")).alias("c")).collect()]
    assert got == ["x = 1", "z", "plain", "open end", "one"]
    texts = ["x Instruction: do it Instruction: again", "指令: 甲 Instruction: b", " none "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.c for r in df.orderBy("i").select(corpus.extract_instruction(F.col("t")).alias("c")).collect()]
    assert got == ["do it", "甲 Instruction: b", "none"]
    verdicts = ['{"is_valid": true, "intent": "n"}', '{"is_valid": "False"}', "[1]", "oops", "{}"]
    df = spark.createDataFrame(list(enumerate(verdicts)), "i int, t string")
    got = [tuple(r.v) for r in df.orderBy("i").select(corpus.parse_verdict(F.col("t"), F.lit("old")).alias("v")).collect()]
    assert got == [(True, "n"), (False, "old"), (True, "old"), (True, "old"), (False, "old")]


# -- samples -----------------------------------------------------------------------
def test_draws_agree_inside_and_outside_of_spark(spark):
    got = spark.range(50).select(F.col("id"), draw(F.col("id"), "s").alias("d")).collect()
    assert all(r.d == draw_name(str(r.id), "s") for r in got)


def test_rounds_take_every_row_once(spark):
    rounds = sampling.sample_rounds(spark.range(1000), "id", 64, 1).groupBy("round").count().collect()
    assert sorted((r.round, r["count"]) for r in rounds) == [(i, 64) for i in range(15)] + [(15, 40)]
    assert sampling.sample_rows(spark.range(1000), "id", 64, 1).count() == 64
    first = {r.id for r in sampling.sample_rows(spark.range(1000), "id", 64, 1).collect()}
    assert first == {r.id for r in sampling.sample_rounds(spark.range(1000), "id", 64, 1).filter("round = 0").collect()}


def test_large_samples_match_small_ones(spark, monkeypatch):
    small = {r.id for r in sampling.sample_rows(spark.range(500), "id", 100, 2).collect()}
    monkeypatch.setattr(sampling, "TOP_N", 10)
    assert {r.id for r in sampling.sample_rows(spark.range(500), "id", 100, 2).collect()} == small


def test_splits_cover_the_table(spark):
    df = to_spark(spark, random_frame(5, 400))
    left, right = sampling.split_for_union(df, "id", 3, nulled=["word"])
    ids = lambda x: {r.id for r in x.select("id").collect()}
    assert ids(left) | ids(right) == set(range(400)) and ids(left) & ids(right)
    assert sorted(right.columns) == sorted(df.columns)
    left, right = sampling.split_for_join(df, "size", 3)
    assert set(left.columns) | set(right.columns) == set(df.columns) and set(left.columns) & set(right.columns) == {"size"}
    assert sampling.quotas(1000) == {"1": 90, "2-3": 60, "4-6": 550, "7+": 300}


# -- key graph ---------------------------------------------------------------------
def least_names(edges):
    """Connected components by plain union-find."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(40)]
    edges += [(f"line{i:03d}", f"line{i + 1:03d}") for i in range(40)] + [("hub", f"leaf{i}") for i in range(30)] + [("self", "self")]
    found = keygraph.components(spark.createDataFrame(edges, "a string, b string"))
    assert {r.node: r.component for r in found.collect()} == least_names(edges)


def test_paths_are_simple_and_follow_edges(spark):
    rng = random.Random(4)
    edges = {(f"t{a}", f"t{b}") for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(20)) if a != b}
    both = edges | {(b, a) for a, b in edges}
    df = spark.createDataFrame(sorted(edges), "a string, b string")
    for n in (2, 3, 4):
        paths = [r.path for r in keygraph.key_paths(df, n, 5).collect()]
        assert paths and all(len(set(p)) == n and all(x in both for x in itertools.pairwise(p)) for p in paths)
        assert len({p[0] for p in paths}) == len(paths)
    assert {p for p, _ in both} == {r.start for r in keygraph.key_paths(df, 2).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_every_path_that_exists_is_found(spark, seed):
    rng = random.Random(seed)
    edges = {(f"t{rng.randrange(9)}", f"t{rng.randrange(9)}") for _ in range(9)} | {("b", "a"), ("a", "c"), ("c", "d")}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def reaches(path, n):
        return len(path) == n or any(reaches([*path, x], n) for x in near[path[-1]] if x not in path)

    df = spark.createDataFrame(sorted(edges), "a string, b string")
    for n in (3, 4, 5):
        paths = {r.start: r.path for r in keygraph.key_paths(df, n, seed).collect()}
        assert set(paths) == {a for a in near if reaches([a], n)}
        assert all(len(set(p)) == n and all(y in near[x] for x, y in itertools.pairwise(p)) for p in paths.values())


def test_catalogue(spark):
    record = {"db_id": "d", "table_names": ["x", "y", "z", "alone"], "column_names": [[0, "id"], [1, "x_id"], [1, "id"], [2, "y_id"]],
              "foreign_keys": [[1, 0], [3, 2]]}
    df = spark.createDataFrame(
        [(record["db_id"], record["table_names"], [tuple(c) for c in record["column_names"]], record["foreign_keys"])],
        "db_id string, table_names array<string>, column_names array<struct<table_index: int, name: string>>, foreign_keys array<array<int>>")
    edges = keygraph.catalogue_edges(df)
    assert sorted(map(tuple, edges.collect())) == [("d.y", "d.x", "x_id", "id"), ("d.z", "d.y", "y_id", "id")]
    chosen = keygraph.joinable_tables(edges, 3).collect()
    assert [(r.component, r.tables) for r in chosen] == [("d.x", ["d.x", "d.y", "d.z"])]
    assert keygraph.joinable_tables(edges, 4).first().tables == ["d.x", "d.y", "d.z"]
    paths = keygraph.key_paths(edges, 2)
    assert keygraph.path_columns(paths, edges).count() == paths.count()


# -- many results at once ----------------------------------------------------------
def cells_of(tables):
    return [(item, i, c, None if v is None else str(v)) for item, frame in tables.items()
            for i, row in enumerate(frame) for c, v in row.items()]


@pytest.mark.parametrize("heavy_rows", [1, 1_000_000])
def test_score_results(spark, heavy_rows, monkeypatch):
    monkeypatch.setattr("rowwright.functions.ranking.HEAVY_ROWS", heavy_rows)
    table = [{"k": "a", "x": 1}, {"k": "b", "x": 2.5}, {"k": "b", "x": None}]
    targets = {n: table for n in ("same", "shuffled", "close", "value", "text", "rows", "column", "extra", "absent")}
    results = {
        "same": table, "shuffled": table[::-1], "close": [{**r, "x": r["x"] and r["x"] + 1e-9} for r in table],
        "value": [{**r, "x": 7} for r in table], "text": [{**r, "k": "a"} for r in table], "rows": table[:2],
        "column": [{"k": r["k"]} for r in table], "extra": [{**r, "y": 1} for r in table],
    }
    schema = "item string, row int, column string, value string"
    got = scoring.score_results(spark.createDataFrame(cells_of(results), schema), spark.createDataFrame(cells_of(targets), schema))
    assert {r.item: (r.status, r.error) for r in got.collect()} == {
        "same": ("success", None), "shuffled": ("success", None), "close": ("success", None),
        "value": ("partial", "column mismatch: x"), "text": ("partial", "column mismatch: k"),
        "rows": ("partial", "row count mismatch: 2 instead of 3"), "column": ("partial", "missing column x"),
        "extra": ("partial", "extra column y"), "absent": ("error", "no result")}


@pytest.mark.parametrize(("bits", "near"), [(12, 10_000), (3, 4), (12, 0)])
def test_quotas_are_the_first_draws(spark, monkeypatch, bits, near):
    monkeypatch.setattr(sampling, "SLICE_BITS", bits)
    monkeypatch.setattr(sampling, "TOP_N", near)
    df = spark.range(3000).withColumn("g", F.expr("case when id % 3 = 0 then 'a' when id < 100 then 'b' else 'c' end"))
    limits = {"a": 137, "b": 500, "c": 1, "d": 4, "e": 0}
    got = df.filter(sampling.first_drawn(df, F.col("g"), F.col("id"), limits, 5)).collect()
    drawn = sorted((r.d, r.id, r.g) for r in df.withColumn("d", draw(F.col("id"), 5)).collect())
    for g, n in limits.items():
        assert {r.id for r in got if r.g == g} == {i for _, i, own in [x for x in drawn if x[2] == g][:n]}


def test_catalogue_pairs_agree_with_single_tables(spark):
    names = ["sales_2019", "sales_2020", "cost_2019", "cost_2020", "id", "a.b.1", "x 1 y"]
    tables = {"t1": names, "t2": names[:3], "t3": ["id"]}
    rows = [(t, i, c, "bigint" if (t, c) != ("t3", "id") else "string") for t, own in tables.items() for i, c in enumerate(own)]
    catalogue = spark.createDataFrame(rows, "table string, position int, column string, dtype string")
    got = {(r.table, frozenset((r.one, r.two)), r.beginnings) for r in profiling.catalogue_name_pairs(catalogue).collect()}
    assert got == {(t, frozenset(p[:2]), p[2]) for t, own in tables.items() for p in profiling.wide_name_pairs(own)}
    pairs = {(r.one, r.two): (r.shared, r.joins, r.unions) for r in profiling.table_pairs(catalogue).collect()}
    assert pairs == {("t1", "t2"): (3, True, False)}


def test_scores_take_a_tolerance(spark):
    cells = lambda x: spark.createDataFrame([("t", 0, "n", x), ("t", 0, "w", "a")], "item string, row int, column string, value string")
    assert scoring.score_results(cells("1.0"), cells("1.4")).first().status == "partial"
    assert scoring.score_results(cells("1.0"), cells("1.4"), tolerance=0.5).first().status == "success"
    assert scoring.score_results(cells("1.0"), cells("1.4"), tolerance=0, relative=0.3).first().status == "success"


@pytest.mark.parametrize("heavy_rows", [1, 1_000_000])
def test_scores_of_cells_without_names(spark, heavy_rows, monkeypatch):
    monkeypatch.setattr("rowwright.functions.ranking.HEAVY_ROWS", heavy_rows)
    schema = "item string, row int, column string, value string"
    results = [("blank", 0, None, "1"), ("more", 0, None, "0"), ("more", 1, "x", "1"), (None, 0, "x", "1"), ("unnamed", 0, None, "1")]
    targets = [("blank", 0, "x", "1"), ("more", 0, "x", "1"), (None, 0, "x", "1"), ("unnamed", 0, None, "1"), ("absent", None, "x", None)]
    scored = scoring.score_results(spark.createDataFrame(results, schema), spark.createDataFrame(targets, schema))
    assert {r.item: (r.status, r.error) for r in scored.collect()} == {
        "blank": ("partial", "missing column x"), "more": ("success", None), "absent": ("error", "no result")}


def test_tables_are_scored_over_as_many_tasks_as_their_cells_need(spark, monkeypatch):
    monkeypatch.setattr("rowwright.functions.ranking.TASK_ROWS", 100, raising=False)
    cells = spark.range(1200).selectExpr("concat('t', id div 4) as item", "id div 2 % 2 as row", "concat('c', id % 2) as column", "cast(id as string) as value")
    scored = scoring.score_results(cells, cells)
    # all cells of a task meet in one shuffle, 100 a partition
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange \w+\((\w+)#\d+L?, (\d+)\)", plan) == [("item", "24")] and plan.count("Exchange") == 1
    assert [tuple(r) for r in scored.groupBy("status").count().collect()] == [("success", 300)]


def test_rows_are_numbered_over_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr("rowwright.functions.ranking.TASK_ROWS", 100, raising=False)
    ranked = rank_in_groups(spark.range(2000).selectExpr("id % 400 as g", "id"), ["g"], [F.col("id")], "n", ["g"])
    assert ranked.rdd.getNumPartitions() == 20
    assert [tuple(r) for r in ranked.groupBy("n").count().orderBy("n").collect()] == [(n, 400) for n in range(1, 6)]


def test_components_of_names_that_share_a_number(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "e"), ("d", "f")], "a string, b string")
    nodes, links = keygraph._numbered_graph(edges, lambda name: F.ascii(name) % 3)
    assert nodes.select("id").distinct().count() == 6 and links.count() == 3


def test_components_of_a_chain_need_few_rounds(spark):
    chain = spark.range(3000).select(F.lpad("id", 5, "0").alias("a"), F.lpad(F.col("id") + 1, 5, "0").alias("b"))
    assert [tuple(r) for r in keygraph.components(chain, max_rounds=25).groupBy("component").count().collect()] == [("00000", 3001)]


def test_words_are_told_by_their_first_letter(spark):
    texts = ["vx", "nan", "Inf", "Jan 5, 2020", "d", "May 7, 2021", " 12 ", "-1e3", "2020-01-02", "ä", "", "T"]
    df = spark.createDataFrame([(t,) for t in texts], "w string")
    row = profiling.profile_columns(df).first()
    plain = df.select(F.count_if(F.col("w").rlike(profiling.NUMBER_TEXT)), F.count_if(profiling.to_moment(F.col("w"), df.schema[0].dataType).isNotNull())).first()
    assert (row.numbers, row.moments) == tuple(plain)
    plan = profiling.profile_columns(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "ascii(w" in plan


def test_key_paths_store_little_more_than_the_links(spark, monkeypatch):
    links = spark.createDataFrame([(f"s{i}", f"p{j}") for i in range(30) for j in range(20)], "a string, b string")
    stored, store = [], keygraph.cut_lineage

    def counted(df):
        kept = store(df)
        stored.append(kept.count())
        return kept

    monkeypatch.setattr(keygraph, "cut_lineage", counted)
    assert keygraph.key_paths(links, 3, 1).count() == 50
    assert sum(stored) < 2 * 600 * 2  # the links both ways, and less than that again of paths


def test_table_pairs_are_counted_where_their_lists_are(spark, monkeypatch, capsys):
    monkeypatch.setattr(profiling, "LISTED", 2)  # long lists are cut
    tables = {f"t{i}": [("id", "int" if i % 3 else "text"), (f"c{i % 4}", "int")] for i in range(12)}
    rows = [(t, n, c, kind) for t, own in tables.items() for n, (c, kind) in enumerate(own)]
    found = profiling.table_pairs(spark.createDataFrame(rows, "table string, position int, column string, dtype string"))
    want = {}
    for a, b in ((a, b) for a in tables for b in tables if a < b):
        one, two = dict(tables[a]), dict(tables[b])
        both = one.keys() & two.keys()
        if all(one[c] == two[c] for c in both):
            want[a, b] = (len(both), True, tables[a] == tables[b])
    assert {(r.one, r.two): (r.shared, r.joins, r.unions) for r in found.collect()} == want
    found.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[0]
    assert "Generate explode" in plan and plan.index("Generate explode") < plan.index("Exchange")


def test_names_of_a_table_are_brought_together_once(spark, capsys):
    rows = [(f"t{i}", f"b{k}_{end}") for i in range(20) for k in range(3) for end in ("x", "y")]
    found = profiling.catalogue_name_pairs(spark.createDataFrame(rows, "table string, column string"))
    found.explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    assert {(r.table, r.one, r.two, r.beginnings) for r in found.collect()} >= {(f"t{i}", "x", "y", 3) for i in range(20)}
