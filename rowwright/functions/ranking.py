"""Row numbers that stay parallel when one group holds much of the table.

A window over a group runs in one task.  These helpers cut large groups into chunks
of bounded size, number the rows inside a chunk, and add the number of rows in the
chunks before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .hashing import RANGE_BITS
from .names import col

CHUNK, OFFSET, TIE, COPIES, COPY = "__chunk", "__offset", "__tie", "__copies", "__copy"
BLOCK = 4096  # copies made from one row of an inner list
# a hash bucket is heavy above this many rows, if that is also far above the mean
HEAVY_ROWS, HEAVY_FACTOR, BUCKETS = 1_000_000, 5, 4096
# rows placed in one task; up to MERGED tasks the rows sent to them are not held in memory where they come from, so beyond
# that tasks grow before there are more of them
TASK_ROWS, LARGE_TASK_ROWS, MERGED = 500_000, 2_000_000, 200


def repeat_rows(counted: DataFrame, count: str, number: str) -> DataFrame:
    """Every row as often as its ``count``, copies numbered from 0; two short lists instead of a long one."""
    blocks = counted.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / BLOCK))))
    low = F.col("__block") * BLOCK
    inside = F.sequence(low, F.least(low + (BLOCK - 1), F.col(count) - 1))
    return blocks.withColumn(number, F.explode(inside)).drop("__block")


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks share so many rows, no fewer than the cluster's shuffle width."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, min(MERGED, math.ceil(rows / TASK_ROWS)), math.ceil(rows / LARGE_TASK_ROWS))


def place(df: DataFrame, rows: int, names: list[str]) -> DataFrame:
    """``df`` of about so many rows dealt by the hash of some columns; the number of tasks grows with the rows.

    Left to themselves, tasks are as many as the shuffle width or are joined by their size in the shuffle, which says little
    about rows that compress well.
    """
    keys = [col(n) for n in names]
    return df.repartition(*keys) if rows <= TASK_ROWS else df.repartition(tasks_for(df.sparkSession, rows), *keys)


def heavy_buckets(df: DataFrame, spread: list[str]) -> tuple[Column, list[int], int, int]:
    """The bucket of a row by the hash of ``spread``, the buckets with far more rows than others, and how many rows are
    in the other buckets and in these.

    One pass over the ``spread`` columns that shuffles one count per bucket and task.
    """
    buckets = max(BUCKETS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64(*[col(s) for s in spread]), F.lit(buckets))
    counts = dict(map(tuple, df.groupBy(bucket.alias("bucket")).count().collect()))
    bound = max(HEAVY_ROWS, HEAVY_FACTOR * sum(counts.values()) / buckets)
    heavy = [b for b, n in counts.items() if n > bound]
    in_heavy = sum(counts[b] for b in heavy)
    return bucket, heavy, sum(counts.values()) - in_heavy, in_heavy


def _running_offsets(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Rows in earlier chunks of the same group; ``counts`` has one row per chunk."""
    keys = [col(g) for g in groups] or [F.lit(0)]
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(OFFSET, F.coalesce(F.sum("count").over(before), F.lit(0).cast("bigint")))


def rank_by_draw(df: DataFrame, groups: list[str], drawn: str, ties: list[str], name: str,
                 chunks: int | None = None) -> DataFrame:
    """Number the rows of each group by a ``hashing.draw`` column, from 1.

    Draws of unique keys are uniform, so equal slices of their range hold about
    equally many rows and need no sampling, no sort order and no stored copy.
    Meant for few groups; the slices follow the cluster's shuffle width.
    """
    chunks = chunks or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.withColumn(CHUNK, F.shiftright(col(drawn) * F.lit(chunks).cast("bigint"), RANGE_BITS).cast("int"))
    counts = sliced.groupBy(*[col(g) for g in groups], CHUNK).count()
    offsets = _running_offsets(counts, groups).drop("count")
    inside = Window.partitionBy(*[col(g) for g in groups], CHUNK).orderBy(col(drawn), *[col(t) for t in ties])
    numbered = sliced.withColumn(name, F.row_number().over(inside))
    left, right = numbered.alias("n"), offsets.alias("o")
    same = [F.col(f"n.{CHUNK}") == F.col(f"o.{CHUNK}")]
    same += [F.col(f"n.`{g}`").eqNullSafe(F.col(f"o.`{g}`")) for g in groups]
    total = (F.col(f"n.{name}") + F.col(f"o.{OFFSET}")).alias(name)
    return left.join(right, same).select(*[F.col(f"n.`{c}`") for c in df.columns], total)


def rank_in_groups(df: DataFrame, groups: list[str], order: list[Column], name: str,
                   spread: list[str]) -> DataFrame:
    """Number the rows of each group by value order, whatever the size of the groups.

    Rows are placed by the hash of ``spread`` (some of ``groups``) and numbered by a
    plain window; a later grouping by ``spread`` and the number needs no new shuffle.
    Buckets of that hash that hold far more rows than others are ranked by
    ``rank_by_value`` instead (``heavy_buckets``).
    """
    if not spread:
        return rank_by_value(df, groups, order, name)
    bucket, heavy, n_light, n_heavy = heavy_buckets(df, spread)

    def plain(rows: DataFrame) -> DataFrame:
        window = Window.partitionBy(*[col(g) for g in groups]).orderBy(*order)
        return place(rows, n_light, spread).withColumn(name, F.row_number().over(window))

    if not heavy:
        return plain(df)
    light = plain(df.filter(~bucket.isin(*heavy)))
    ranked = rank_by_value(df.filter(bucket.isin(*heavy)), groups, order, name, tasks_for(df.sparkSession, n_heavy))
    return light.unionByName(ranked)


def rank_by_value(df: DataFrame, groups: list[str], order: list[Column], name: str,
                  partitions: int | None = None) -> DataFrame:
    """Number the rows of each group by value order (nulls first), from 1.

    Rows are range-partitioned by group, order and a hash of the whole row and the
    number of its copy, so even rows that are equal throughout spread over partitions,
    and a row lost with its executor returns to the same place.  Only a group that crosses a
    partition border needs an offset: fewer groups than partitions, hence the
    broadcast is bounded by the partition count, not by the data.  The ranges come
    from a sample, so the placement is stored before it is used twice.
    """
    spark = df.sparkSession
    width = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = [o.alias(f"__o{i}") for i, o in enumerate(order)]
    copies = df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias(COPIES))
    keyed = repeat_rows(copies, COPIES, COPY).select(
        *[col(c) for c in df.columns], *ordered, F.xxhash64(*[col(c) for c in df.columns], F.col(COPY)).alias(TIE))
    order_names = [f"__o{i}" for i in range(len(order))] + [TIE]
    placed = keyed.repartitionByRange(width, *[col(g) for g in groups], *order_names)
    placed = cut_lineage(placed.withColumn(CHUNK, F.spark_partition_id()))

    inside = Window.partitionBy(CHUNK, *[col(g) for g in groups]).orderBy(*order_names)
    numbered = placed.withColumn(name, F.row_number().over(inside))

    member = F.struct(*[col(g) for g in groups]) if groups else F.lit(0)
    ends = placed.groupBy(CHUNK).agg(F.min(member).alias("low"), F.max(member).alias("high"))
    border = ends.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("member")).distinct()
    counts = (
        placed.select(CHUNK, member.alias("member"))
        .join(F.broadcast(border), "member")
        .groupBy(CHUNK, "member").count()
    )
    offsets = _running_offsets(counts, ["member"]).filter(F.col(OFFSET) > 0).drop("count")
    rows = numbered.withColumn("member", member)
    joined = rows.join(F.broadcast(offsets), [CHUNK, "member"], "left")
    total = (F.col(name) + F.coalesce(F.col(OFFSET), F.lit(0))).alias(name)
    return joined.select(*[col(c) for c in df.columns], total)
