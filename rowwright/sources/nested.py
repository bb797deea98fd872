"""Many small tables in one source: nested JSON lines, table folders, table pairs.

Such collections become one long table of cells ``(item, row, column, value)``, so a
job over thousands of tables is one scan and one shuffle, not a loop.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import as_list, col
from ..session import cut_lineage
from .records import BLOCK, csv_records
from .tables import cap_columns, read_csv

NESTED_SCHEMA = "{id} string, `table` struct<columns: array<string>, data: array<array<string>>>"


def read_nested_tables(spark: SparkSession, path: str, id_column: str = "id", max_columns: int | None = None) -> DataFrame:
    """Cells of JSON lines such as ``{"id": .., "table": {"columns": [..], "data": [[..]]}}``."""
    lines = spark.read.schema(NESTED_SCHEMA.format(id=f"`{id_column}`")).json(path)
    return nested_cells(lines, id_column, max_columns)


def _first(values, limit: int | None):
    return values if limit is None else F.slice(values, 1, limit)


def nested_cells(lines: DataFrame, id_column: str = "id", max_columns: int | None = None) -> DataFrame:
    """Cells of all columns, or of the first ``max_columns`` where the caller names a limit."""
    rows = lines.select(
        col(id_column).alias("item"),
        _first(F.col("table.columns"), max_columns).alias("names"),
        F.posexplode("table.data").alias("row", "values"),
    )
    cells = rows.select("item", "row", F.posexplode(F.arrays_zip("names", _first(F.col("values"), max_columns).alias("v"))))
    return cells.select(
        "item", "row", F.col("pos").alias("position"),
        F.col("col.names").alias("column"), F.col("col.v").alias("value"),
    ).filter(F.col("column").isNotNull())


def nested_table(lines: DataFrame, item: str, id_column: str = "id", max_columns: int | None = None) -> DataFrame:
    """One of the tables with its own columns (as text); reads its header first."""
    found = lines.filter(col(id_column) == item)
    header = found.select("table.columns").first()
    if header is None:
        raise ValueError(f"no table {item!r}")
    rows = found.select(F.explode("table.data").alias("values"))
    return rows.select(*[F.get("values", F.lit(i)).alias(n) for i, n in enumerate(header[0][:max_columns])])


def read_table_folder(spark: SparkSession, path: str | list[str], max_columns: int | None = None) -> DataFrame:
    """Cells of a folder of CSV files with different headers; ``item`` is the file's path below the
    folder (below what all given paths have in common, if there are several).

    Large files are split over tasks, line breaks inside cells included (``records.csv_records``); their records are
    stored once.  They are read as text columns, as many as the record with most commas can have;
    ``max_columns`` cuts wider files.
    """
    records = cut_lineage(csv_records(spark, path).select(_below(path, F.col("file")).alias("item"), *BLOCK, "number", "record"))
    if max_columns is None:
        max_columns = records.agg(F.max(F.size(F.split("record", ","))).alias("n")).first().n or 1
    width = ", ".join(f"c{i} string" for i in range(max_columns))
    parsed = F.from_csv("record", width, {"escape": '"', "multiLine": "true"})
    values = F.array(*[parsed[f"c{i}"] for i in range(max_columns)]).alias("values")
    # a record's place in its file: those in earlier blocks and those before it in its own
    earlier = Window.partitionBy("item", "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = records.groupBy("item", *BLOCK).agg(F.count("*").alias("n"))
    first = counts.select("item", *BLOCK, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("item", *BLOCK).orderBy("number")
    placed = records.select("item", *BLOCK, "number", values).withColumn("at", F.row_number().over(inside))
    placed = placed.join(first, ["item", *BLOCK]).select("item", (F.col("first") + F.col("at") - 2).alias("row"), "values")
    headers = records.groupBy("item").agg(F.min_by("record", F.struct(*BLOCK, "number")).alias("record")).select(
        "item", values.alias("names"))
    rows = placed.filter("row >= 0").join(headers, "item")
    cells = rows.select("item", "row", F.posexplode(F.arrays_zip("names", "values")))
    return cells.select(
        "item", "row", F.col("pos").alias("position"),
        F.col("col.names").alias("column"), F.col("col.values").alias("value"),
    ).filter(F.col("column").isNotNull())


def _below(path: str | list[str], file: Column) -> Column:
    """The decoded path of a file without the folder that was read."""
    folders = [re.split(r"[*?\[{]", re.sub(r"^[a-z0-9+.-]+:(//[^/]*)?", "", p))[0] for p in as_list(path)]
    folder = folders[0].rstrip("/") if len(folders) == 1 else os.path.commonpath(folders)
    whole = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    at = F.locate(f"{folder}/", whole)
    name = F.element_at(F.split(whole, "/"), -1)
    return F.when(at > 0, F.substr(whole, at + F.lit(len(folder) + 1))).otherwise(name)


def read_pair_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Which table of a folder belongs to which: ``query_table``, ``candidate_table``."""
    return spark.read.schema("query_table string, candidate_table string").option("header", True).csv(path)


def read_pair(spark: SparkSession, folder: str, query_table: str, candidate_table: str,
              max_columns: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables of one pair, cut to their first columns where the caller names a limit."""
    both = [read_csv(spark, f"{folder.rstrip('/')}/{name}", multiline=True) for name in (query_table, candidate_table)]
    return tuple(both if max_columns is None else [cap_columns(df, max_columns) for df in both])


def pair_cells(manifest: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of all pairs at once: the union of each query table with its candidates."""
    sides = manifest.select(
        F.concat_ws("|", "query_table", "candidate_table").alias("pair"),
        F.inline(F.array(
            F.struct(F.lit("query").alias("side"), F.col("query_table").alias("item")),
            F.struct(F.lit("candidate").alias("side"), F.col("candidate_table").alias("item")),
        )),
    )
    return sides.join(cells, "item").select("pair", "side", "item", "row", "column", "value")


def previews(cells: DataFrame, rows: int = 10) -> DataFrame:
    """First rows of every table, one line per row; rows are numbered, so no ranking is needed."""
    return cells.filter(F.col("row") < rows).groupBy("item", "row").agg(
        F.array_sort(F.collect_list(F.struct("position", "column", "value"))).alias("cells")
    )
