"""Result tables of many tasks against their targets, in one job.

``comparing`` serves two large tables.  A corpus has thousands of small ones; they
arrive as cells ``(item, row, column, value)`` from ``sources.nested``, and every
task is judged by the same rules without a job of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.convert import to_number
from ..functions.ranking import heavy_buckets, place, rank_by_value, tasks_for
from ..session import cut_lineage
from .comparing import ABSOLUTE, RELATIVE, close, grid_cell

SIDE, RANK = "__side", "__rank"


def _sides(results: DataFrame, targets: DataFrame) -> DataFrame:
    wanted = ["item", "row", "column", "value"]
    return results.select(*wanted, F.lit(0).alias(SIDE)).unionByName(targets.select(*wanted, F.lit(1).alias(SIDE)))


def _column_facts() -> dict[str, Column]:
    """Of a task's column: on which sides it is, and whether all its cells are numbers there."""
    number = to_number(F.col("value"), T.StringType())
    return {"in_result": F.bool_or(F.col(SIDE) == 0), "in_target": F.bool_or(F.col(SIDE) == 1),
            "numeric": F.bool_and(F.col("value").isNull() | number.isNotNull())}


def score_results(results: DataFrame, targets: DataFrame, tolerance: float = ABSOLUTE, relative: float = RELATIVE) -> DataFrame:
    """``(item, status, error)``: ``success``, or ``partial`` and the first rule that failed.

    The rules are those for two tables: the same columns in any order, as many rows, and
    equal cells once both sides are sorted, text columns first.  A column that holds
    numbers only is compared within ``tolerance + relative * |target|``.  A task without a result is an ``error``.

    Cells are counted first, then brought together by task once, over as many tasks of Spark as the cells need.  Tasks that hold
    much of the corpus are split over tasks of Spark.
    """
    cells = _sides(results, targets).filter(F.col("item").isNotNull())
    bucket, heavy, n_light, n_heavy = heavy_buckets(cells, ["item"])
    light = cells.filter(~bucket.isin(*heavy)) if heavy else cells
    judged = _judged_in_place(place(light, n_light, ["item"]), tolerance, relative)
    if heavy:
        judged = judged.unionByName(_judged_in_parts(cells.filter(bucket.isin(*heavy)), n_heavy, tolerance, relative))
    error = (
        F.when(~F.col("has_result"), "no result")
        .when(F.col("missing").isNotNull(), F.concat(F.lit("missing column "), "missing"))
        .when(F.col("extra").isNotNull(), F.concat(F.lit("extra column "), "extra"))
        .when(F.col("n_got") != F.col("n_want"),
              F.concat(F.lit("row count mismatch: "), F.col("n_got"), F.lit(" instead of "), F.col("n_want")))
        .when(F.col("bad").isNotNull(), F.concat(F.lit("column mismatch: "), "bad"))
    )
    status = F.when(~F.col("has_result"), "error").when(error.isNull(), "success").otherwise("partial")
    return judged.select("item", status.alias("status"), error.alias("error"))


def _judged_in_place(cells: DataFrame, tolerance: float, relative: float) -> DataFrame:
    """Per task what its rules need; all cells of a task are in one partition, so nothing is shuffled."""
    same_column, same_side = Window.partitionBy("item", "column"), Window.partitionBy(SIDE, "item")
    known = cells.select("*", *[measure.over(same_column).alias(name) for name, measure in _column_facts().items()])
    named = F.col("column").isNotNull()
    lines = known.groupBy("item", SIDE, "row").agg(
        F.array_sort(F.collect_list(F.when(named, _cell()))).alias("cells"),
        *[F.min(F.when(there, F.col("column"))).alias(name) for name, there in _one_sided().items()])
    lines = lines.withColumn("full", F.size("cells") > 0)  # rows without any named cell are no rows, but a result
    ranked = lines.withColumn(RANK, F.row_number().over(same_side.orderBy(~F.col("full"), *_order(tolerance))))
    pairs = ranked.groupBy("item", RANK).agg(
        *_both(F.col("full")), F.bool_or(F.col(SIDE) == 0).alias("has_result"), F.min("extra").alias("extra"), F.min("missing").alias("missing"))
    return pairs.groupBy("item").agg(
        F.bool_or("has_result").alias("has_result"), F.min("extra").alias("extra"), F.min("missing").alias("missing"),
        *_verdict(tolerance, relative)).filter(F.col("n_got") + F.col("n_want") > 0)


def _judged_in_parts(cells: DataFrame, n_cells: int, tolerance: float, relative: float) -> DataFrame:
    """The same for tasks too large for one partition: their rows are spread by row, their numbers by rank."""
    columns = cells.groupBy("item", "column").agg(*[measure.alias(name) for name, measure in _column_facts().items()])
    names = columns.groupBy("item").agg(
        F.bool_or("in_result").alias("has_result"),
        *[F.min(F.when(there, F.col("column"))).alias(name) for name, there in _one_sided().items()])
    typed = cells.join(columns.select("item", "column", "numeric"), ["item", "column"])
    # one line per table row: as many cells as the table has columns, texts before numbers
    lines = place(typed, n_cells, ["item", SIDE, "row"]).groupBy("item", SIDE, "row").agg(F.array_sort(F.collect_list(_cell())).alias("cells"))
    ranked = rank_by_value(cut_lineage(lines), [SIDE, "item"], _order(tolerance), RANK, tasks_for(cells.sparkSession, n_cells))
    pairs = place(ranked, n_cells, ["item", RANK]).groupBy("item", RANK).agg(*_both(F.lit(True)))
    return names.join(pairs.groupBy("item").agg(*_verdict(tolerance, relative)), "item")


def _one_sided() -> dict[str, Column]:
    """Which columns are on one side only, from their facts."""
    return {"extra": F.col("in_result") & ~F.col("in_target"), "missing": ~F.col("in_result") & F.col("in_target")}


def _cell() -> Column:
    number = to_number(F.col("value"), T.StringType())
    return F.struct(
        "numeric", "column", F.when(~F.col("numeric"), F.col("value")).alias("text"),
        F.when(F.col("numeric"), number).alias("number"))


def _order(tolerance: float) -> list[Column]:
    """Rows in the order of their texts, then of the cells of the tolerance of their numbers."""
    return [F.col("cells.text"), F.transform("cells.number", lambda n: grid_cell(n, tolerance)), F.col("cells.number")]


def _both(there: Column) -> list[Column]:
    """The cells of the two rows that meet."""
    return [F.max(F.when((F.col(SIDE) == side) & there, F.col("cells"))).alias(name) for side, name in ((0, "got"), (1, "want"))]


def _verdict(tolerance: float, relative: float) -> list[Column]:
    """How many rows there are on both sides, and the first column in which rows that meet differ."""
    differing = F.filter(F.arrays_zip("got", "want"), lambda p: ~_same_cell(p.got, p.want, tolerance, relative))
    return [
        F.count_if(F.col("got").isNotNull()).alias("n_got"), F.count_if(F.col("want").isNotNull()).alias("n_want"),
        F.min(F.when(F.col("got").isNotNull() & F.col("want").isNotNull(),
                     F.array_min(F.transform(differing, lambda p: p.want.column)))).alias("bad")]


def _same_cell(a, b, tolerance: float, relative: float):
    texts = a.text.eqNullSafe(b.text)
    return texts & close(a.number, b.number, tolerance, relative)
