"""Pairing the rows of two tables one to one when several number columns may differ a little.

Rows may be paired if their exact columns agree and every number is within the tolerance.
Numbers are put into cells of a scale on which the tolerance is about one everywhere, so partners
lie in the same cell or at most two cells on in every column.  Occupied cells that are such neighbours are
linked; a connected component of cells is a group of candidates that no partner can leave.  Inside
a component rows are matched along augmenting paths.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.convert import whole_below
from ..functions.names import col
from ..session import cut_lineage
from .keygraph import components

REACH = 2


def tolerance_cell(number: Column, tolerance: float, relative: float) -> Column:
    """The cell of a number: numbers of one cell are within ``tolerance + relative * |b|`` of each other,
    and numbers within it of each other are at most ``REACH`` cells apart.  Without a tolerance the number itself."""
    size = F.abs(number)
    if tolerance <= 0 and relative <= 0:
        return number + F.lit(0.0)  # no negative zero
    if relative <= 0:
        return whole_below(number / F.lit(tolerance))
    width = math.log1p(relative) * (1 - 1e-9)
    if tolerance > 0:
        return whole_below(F.signum(number) * F.log1p(size * F.lit(relative / tolerance)) / F.lit(width))
    # only zero is near zero: the cells of either sign begin far from it
    steps = F.rint(F.log(size) / F.lit(width)) + F.lit(1e4 / width)
    return F.when(number == 0, F.lit(0.0)).otherwise(F.signum(number) * steps)


def is_close(a: float | None, b: float | None, tolerance: float, relative: float) -> bool:
    if a is None or b is None:
        return a is b
    return a == b or abs(a - b) <= tolerance + relative * abs(b)


def unmatched(lefts: list[tuple], rights: list[tuple], tolerance: float, relative: float) -> int:
    """How many left rows find no partner in a largest matching; rows are ``(copies, cells, numbers)``."""
    near = defaultdict(list)
    for j, (_, cells, _) in enumerate(rights):
        near[cells[0]].append(j)

    def partners(i: int) -> list[int]:
        _, cells, numbers = lefts[i]
        first = cells[0]
        around = [None] if first is None else list(dict.fromkeys(first + d for d in (0, 1, -1, 2, -2)))
        return [j for c in around for j in near.get(c, ())
                if all(map(lambda a, b: is_close(a, b, tolerance, relative), numbers, rights[j][2]))]

    edges = [partners(i) for i in range(len(lefts))]
    room = [copies for copies, *_ in rights]
    given: list[dict[int, int]] = [{} for _ in rights]  # by right row: how many of each left row it has
    missing = 0
    for i, (copies, *_) in enumerate(lefts):
        while copies:
            # the shortest path to a right row with room, by way of left rows that can move on to another partner
            via: dict[int, int] = {}
            held_by: dict[int, int] = {}
            queue, end = deque([i]), None
            while queue and end is None:
                at = queue.popleft()
                for j in edges[at]:
                    if j in via:
                        continue
                    via[j] = at
                    if room[j]:
                        end = j
                        break
                    for k in given[j]:
                        if k != i and k not in held_by:
                            held_by[k] = j
                            queue.append(k)
            if end is None:
                missing += copies
                break
            path, j = [], end
            while True:
                path.append((via[j], j))
                if via[j] == i:
                    break
                j = held_by[via[j]]
            amount = min([copies, room[end], *[given[held_by[k]][k] for k, _ in path if k != i]])
            for k, j in path:
                given[j][k] = given[j].get(k, 0) + amount
                if k != i:
                    given[held_by[k]][k] -= amount
                    if not given[held_by[k]][k]:
                        del given[held_by[k]][k]
            room[end] -= amount
            copies -= amount
    return missing


def _near(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) | (F.abs(a - b) <= REACH), a.isNull() & b.isNull())


def pairable(rows: DataFrame, exact: list[str], numbers: list[str], side: str, tolerance: float, relative: float) -> DataFrame:
    """The groups (values of the exact columns, after a name of the group) whose rows on both sides can all be
    paired one to one.

    ``rows`` are the rows of both tables, told apart by ``side`` (0 or 1).  Cells whose rows on the two sides are equal in number
    and that have no neighbours need no more than a count; a component with more rows on one side rejects its group at once.
    Only what is left is matched, a component in one task: rows within the tolerance of each other in a chain, within one
    group of exact values.
    """
    named = rows.select(*[col(n).alias(f"e{i}") for i, n in enumerate(exact)],
                        *[(col(n).cast("double") + F.lit(0.0)).alias(f"v{i}") for i, n in enumerate(numbers)], F.col(side).alias("side"))
    exact_names, values = [f"e{i}" for i in range(len(exact))], [f"v{i}" for i in range(len(numbers))]
    same = [F.col(f"e{i}").eqNullSafe(F.col(f"w{i}")) for i in range(len(exact))]
    if exact:
        hopeful = cut_lineage(_with_close_sums(named, exact_names, values, tolerance, relative))
        if hopeful.isEmpty():
            return hopeful.toDF("__group", *exact)
        named = named.join(hopeful.select(*[F.col(e).alias(f"w{i}") for i, e in enumerate(exact_names)]), same, "left_semi")
    cells = [tolerance_cell(F.col(v), tolerance, relative).alias(f"c{i}") for i, v in enumerate(values)]
    cell_names = [f"c{i}" for i in range(len(values))]
    copied = named.groupBy(*exact_names, *values, "side").agg(F.count("*").alias("copies"))
    group = F.md5(F.to_json(F.struct(*exact_names)).cast("binary")) if exact else F.lit("")
    region = copied.select("*", *cells).withColumn("group", group)
    region = cut_lineage(region.withColumn("node", F.md5(F.concat_ws("|", "group", F.to_json(F.struct(*cell_names))).cast("binary"))))

    surplus = F.sum(F.when(F.col("side") == 0, F.col("copies")).otherwise(-F.col("copies"))).alias("surplus")
    occupied = cut_lineage(region.groupBy("group", "node", *cell_names).agg(surplus))
    steps = F.when(F.col("c0").isNull(), F.array(F.lit(None).cast("double"))).otherwise(
        F.array_distinct(F.array(*[F.col("c0") + d for d in range(-REACH, REACH + 1)])))
    one = occupied.select("group", F.col("node").alias("a"), F.explode(steps).alias("at"), *[F.col(c).alias(f"a_{c}") for c in cell_names[1:]])
    two = occupied.select(F.col("group").alias("in_group"), F.col("node").alias("b"), *cell_names)
    met = (F.col("group") == F.col("in_group")) & F.col("at").eqNullSafe(F.col("c0")) & (F.col("a") < F.col("b"))
    for c in cell_names[1:]:
        met = met & _near(F.col(f"a_{c}"), F.col(c))
    edges = cut_lineage(one.join(two, met).select("a", "b").distinct())

    linked = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rejected = cut_lineage(occupied.filter("surplus <> 0").join(linked, "node", "left_anti").select("group").distinct())
    open_groups = occupied.select("group").distinct().join(rejected, "group", "left_anti")
    if not open_groups.isEmpty() and not edges.isEmpty():
        placed = occupied.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = placed.join(rejected, "group", "left_anti")
        sums = cut_lineage(placed.groupBy("group", "component").agg(
            F.sum("surplus").alias("surplus"), F.bool_or(F.col("surplus") != 0).alias("uneven")))
        uneven = sums.filter("surplus <> 0").select("group").distinct()
        to_match = sums.filter("uneven").join(uneven, "group", "left_anti").select("group", "component")
        items = region.join(placed.select("node", "component"), "node").join(to_match, ["group", "component"])
        items = items.select("group", "component", "side", F.col("copies").cast("long").alias("copies"), F.array(*cell_names).alias("cells"),
                             F.array(*values).alias("numbers"))
        failing = items.repartition("component").sortWithinPartitions("component").mapInArrow(
            _failing_groups(tolerance, relative), "group string")
        rejected = cut_lineage(rejected.unionByName(uneven).unionByName(failing).distinct())
    kept = region.join(rejected, "group", "left_anti").select("group", *exact_names).distinct()
    return kept.toDF("__group", *exact)


def _with_close_sums(rows: DataFrame, exact: list[str], values: list[str], tolerance: float, relative: float) -> DataFrame:
    """Groups in which no column's sums differ by more than all tolerances together; no other can be paired."""
    left = F.col("side") == 0
    measures = []
    for i, v in enumerate(values):
        size = F.abs(v)
        measures += [F.coalesce(F.abs(F.sum(F.when(left, F.col(v)).otherwise(-F.col(v)))), F.lit(0.0)).alias(f"d{i}"),
                     F.coalesce(F.sum(F.when(~left, F.lit(tolerance) + F.lit(relative) * size)) + F.lit(1e-12) * F.sum(size), F.lit(0.0)).alias(f"t{i}")]
    sums = rows.groupBy(*exact).agg(*measures)
    apart = F.lit(False)
    for i in range(len(values)):
        apart = apart | (~F.isnan(f"d{i}") & (F.col(f"d{i}") > F.col(f"t{i}")))
    return sums.filter(~apart).select(F.lit("").alias("group"), *exact)


def _failing_groups(tolerance: float, relative: float):
    """Per partition of rows sorted by component: the groups of components that cannot be paired wholly."""
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[str] = []
        group, at, sides = None, None, ([], [])
        for own, component, side, *row in rows(batches):
            if component != at:
                if unmatched(*sides, tolerance, relative):
                    found.append(group)
                group, at, sides = own, component, ([], [])
            sides[side].append(tuple(row))
        if unmatched(*sides, tolerance, relative):
            found.append(group)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["group"])

    return run
