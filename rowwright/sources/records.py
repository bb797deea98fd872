"""Cutting large text files into records where a line break need not end one.

Files are read in blocks, as lines, by as many tasks as Spark likes.  What a line break means depends on
everything before it, but little of that is needed: for CSV the parity of the quotes, for a JSON document
the depth of its brackets and whether a text is open.  Each block is summed up on its own, running sums over the
few blocks of a file give the state at its start, and then every block cuts its own lines.  Only records
that cross from block to block are joined afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = ["file", "block"]


def file_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, block, line, value)``: lines in blocks of their files; ``line`` grows within a block."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")


def _in_order(parts: Column, name: str, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x[name]), between)


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, block, number, record)``: the text of every CSV record, by the block it begins in.

    A line break ends a record if the quotes before it are even in number; quotes inside quoted cells are doubled, as
    CSV writers do.  Blank lines between records are left out; ``number`` grows within a block, from 1 where records
    begin.  Block and number order the records of a file; number 1 of block 0 is its header.
    """
    lines = file_lines(spark, path)
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumn("quotes", quotes)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy(*BLOCK).agg((F.sum("quotes") % 2).alias("odd"))
    opened = blocks.select(*BLOCK, (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).alias("opened"))

    inside = Window.partitionBy(*BLOCK).orderBy("line")
    before = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = ((F.col("opened") + before) % 2 == 0).cast("long")
    numbered = lines.join(opened, BLOCK).withColumn("begins", begins).withColumn(
        "number", F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy(*BLOCK, "number").agg(
        _in_order(F.collect_list(F.struct("line", "value")), "value", "\n").alias("record"), (F.sum("quotes") % 2).alias("odd"))

    crosses = (F.col("number") == 0) | (F.col("odd") == 1)  # the rest of an earlier record, or one without its end
    so_far = Window.partitionBy("file").orderBy("block", "number").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("number") > 0, F.struct("block", "number")), ignorenulls=True).over(so_far)
    pieces = parts.filter(crosses).withColumn("start", start)
    joined = pieces.groupBy("file", "start").agg(
        _in_order(F.collect_list(F.struct("block", "number", "record")), "record", "\n").alias("record"))
    found = parts.filter(~crosses).select(*BLOCK, "number", "record").unionByName(
        joined.select("file", "start.block", "start.number", "record"))
    record = F.regexp_replace("record", "\r$", "")
    return found.withColumn("record", record).filter(F.col("record") != "")
