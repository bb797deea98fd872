"""Joins on ranges without any equality, by buckets instead of a nested loop.

A condition such as ``left.t >= right.low AND left.t < right.high`` bounds a pair from both sides: the span of the
left row's two expressions must meet the span of the right row's.  A span is put into the one or two
buckets it meets on the level whose bucket width is at least its length (levels are powers of eight).  A
shorter span of the other table looks into its own one or two buckets of every level in use.  So a row is
copied a bounded number of times however long its range is, pairs meet on equal keys, and the condition
itself decides.  Levels whose spans all lie beyond a row are not looked into.  A bucket with many rows on both
sides is cut into tiles, so that the pairs of one bucket are the work of many tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.convert import whole_below
from ..session import cut_lineage

#: Levels of spans without length (their bucket is their value) and without a finite one (one bucket for all).
POINT, ENDLESS = -1000, 1000
#: A bucket where more pairs are tried is cut into tiles of about so many visiting rows by so many rows of the bucket
#: (those are held in memory while the others pass; a merge join holds up to 4,096 without sorting them again).
HEAVY, TILE = 1 << 24, (1 << 14, 1 << 12)
BETWEEN = re.compile(r"([\w.`]+)\s+between\s+([\w.`+\-]+)\s+and\s+([\w.`+\-]+)", re.IGNORECASE)
NAMED = re.compile(r"(?<![\w.])(?:(\w+)\.)?(`[^`]+`|[A-Za-z_]\w*)\s*(\()?")
COMPARED = re.compile(r"([^<>=!'\"]+?)\s*(<=|>=|<|>)\s*([^<>=!'\"]+)")


def _side(text: str, a: DataFrame, b: DataFrame, names: tuple[str, str]) -> int | None:
    """Which table an expression reads, judged by the names in it; None if both, neither or unclear."""
    sides = set()
    for table, column, call in NAMED.findall(text):
        if call:
            continue
        if table:
            sides.add(names.index(table) if table in names else None)
        else:
            sides.add({(True, False): 0, (False, True): 1}.get((column in a.columns, column in b.columns)))
    return sides.pop() if len(sides) == 1 else None


def _qualified(text: str, a: DataFrame, b: DataFrame, names: tuple[str, str]) -> str:
    """The condition with the table written before every bare column name."""
    def named(found: re.Match) -> str:
        table, column, call = found.groups()
        side = None if table or call else _side(found[0], a, b, names)
        return found[0] if side is None else f"{names[side]}.{found[0]}"

    return NAMED.sub(named, text)


def _positional(text: str, columns: tuple[list[str], list[str]], names: tuple[str, str]) -> Column:
    """A qualified condition over ``l0.. r0..``."""
    places = [{c.lower(): f"{mark}{i}" for i, c in reversed(list(enumerate(listed)))} for mark, listed in zip("lr", columns, strict=True)]

    def placed(found: re.Match) -> str:
        table, column, call = found.groups()
        known = places[names.index(table)] if table in names and not call else {}
        at = known.get(column.strip("`").lower())
        return found[0] if at is None else at + found[0][len(found[0].rstrip()):]

    return F.expr(NAMED.sub(placed, text))


def _is_placed(text: str, df: DataFrame) -> bool:
    """Whether values of an expression lie on a line."""
    kind = df.select(F.expr(text)).schema[0].dataType
    return isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def bounds(a: DataFrame, b: DataFrame, condition: str, names: tuple[str, str]) -> tuple[tuple[str, str], tuple[str, str]] | None:
    """The two expressions of each side that bound pairs from both sides, if the condition is a conjunction
    of comparisons without an equality; anything else is left to Spark."""
    text = BETWEEN.sub(r"\1 >= \2 and \1 <= \3", condition)
    under, over = None, None
    for part in re.split(r"\s+and\s+", text.strip(), flags=re.IGNORECASE):
        found = COMPARED.fullmatch(part.strip())
        if not found or re.search(r"\b(or|not|between)\b", part, re.IGNORECASE):
            return None
        one, sign, two = found.groups()
        sides = (_side(one, a, b, names), _side(two, a, b, names))
        if sides == (1, 0):
            one, sign, two = two, {"<": ">", ">": "<"}[sign[0]], one
        elif sides != (0, 1):
            continue
        if not (_is_placed(one, a) and _is_placed(two, b)):
            continue
        if sign[0] == "<":
            under = under or (one, two)
        else:
            over = over or (one, two)
    return ((under[0], over[0]), (under[1], over[1])) if under and over else None


def _on_line(text: str, df: DataFrame) -> Column:
    """The value as a double; rounding keeps the order, so no pair is lost."""
    kind = df.select(F.expr(text)).schema[0].dataType
    value = F.expr(text)
    if isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)
    elif isinstance(kind, T.TimestampNTZType):
        value = F.unix_micros(value.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        value = F.unix_date(value) * F.lit(86_400_000_000)  # beside timestamps
    return value.cast("double") + F.lit(0.0)


def _spans(df: DataFrame, ends: tuple[str, str], columns: dict[str, str]) -> DataFrame:
    """Named columns, the span and its level; rows with a missing end meet nothing."""
    one, two = (_on_line(e, df) for e in ends)
    placed = df.select(*[F.col(c).alias(n) for n, c in columns.items()], one.alias("__one"), two.alias("__two"))
    placed = placed.filter("__one IS NOT NULL AND __two IS NOT NULL")
    low, high = F.least("__one", "__two"), F.greatest("__one", "__two")
    length = high - low
    finite = (F.abs("__one") < float("inf")) & (F.abs("__two") < float("inf")) & (length < float("inf"))
    level = F.when(~finite | F.isnan(length), F.lit(ENDLESS)).when(length == 0, F.lit(POINT)).otherwise(
        F.ceil(F.log(length) / F.lit(math.log(8))).cast("int"))
    return placed.select(*columns, low.alias("__low"), high.alias("__high"), level.alias("__level"))


def _bucket(value: str, level: Column) -> Column:
    width = F.pow(F.lit(8.0), level.cast("double"))
    return F.when(level == ENDLESS, F.lit(0.0)).when(level == POINT, F.col(value)).otherwise(
        whole_below(F.col(value) / width))


def _in_buckets(spans: DataFrame, levels: Column) -> DataFrame:
    """A row for each bucket that a span meets on each of the levels (an array)."""
    each = spans.withColumn("__at", F.explode(levels))
    first, last = _bucket("__low", F.col("__at")), _bucket("__high", F.col("__at"))
    # spans without a finite end can only be met where everything meets
    each = each.withColumn("__first", first)
    return each.withColumn("__bucket", F.explode(F.array_distinct(F.array(F.col("__first"), last))))


def _levels(spans: DataFrame) -> dict[int, tuple[float, float]]:
    """Levels in use, with the least and the greatest value of their spans; doubles have fewer than 700 levels."""
    ends = spans.groupBy("__level").agg(F.min("__low"), F.max("__high")).collect()
    return {level: (low, high) for level, low, high in sorted(map(tuple, ends))}


def _looked_into(levels: dict[int, tuple[float, float]], equal: bool) -> Column:
    """The levels of the other table where a row may meet a span: not below the row's own, and with spans that reach it."""
    listed = F.array(*[F.struct(F.lit(v).alias("level"), F.lit(low).alias("low"), F.lit(high).alias("high")) for v, (low, high) in levels.items()])

    def wanted(at: Column) -> Column:
        reached = (at.level == ENDLESS) | ((F.col("__high") >= at.low) & (F.col("__low") <= at.high))
        return reached & (at.level >= F.col("__level") if equal else at.level > F.col("__level"))

    return F.filter(listed.cast("array<struct<level:int,low:double,high:double>>"), wanted).level


def _in_tiles(visiting: DataFrame, home: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``__tile`` and ``__part``, the tile of a heavy bucket: a row is in one of the tiles' rows, or columns, and
    copied to all tiles of it.  Tiles follow a hash of the row, so that they are the same when a task runs again."""
    both = visiting.select("__at", "__bucket", F.lit(1).alias("v"), F.lit(0).alias("h")).unionAll(
        home.select("__home", "__place", F.lit(0), F.lit(1)))
    counts = both.groupBy("__at", "__bucket").agg(F.sum("v").alias("v"), F.sum("h").alias("h"))
    # each of these stands for more than HEAVY pairs to be tried, so there are few of them beside the work to be done
    heavy = cut_lineage(counts.filter(F.col("v").cast("double") * F.col("h") > HEAVY).select(
        F.col("__at").alias("__level"), F.col("__bucket").alias("__heavy"),
        F.ceil(F.col("v") / TILE[0]).alias("__across"), F.ceil(F.col("h") / TILE[1]).alias("__down")))
    if heavy.isEmpty():
        visiting, home = visiting.withColumn("__tile", F.lit(0)), home.withColumn("__part", F.lit(0))
        return _keyed(visiting, "__at", "__bucket", "__tile", "__key"), _keyed(home, "__home", "__place", "__part", "__lock")

    def dealt(df: DataFrame, at: str, bucket: str, mine: str, other: str, number: Callable[[Column, Column], Column], name: str) -> DataFrame:
        plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
        df = df.join(F.broadcast(heavy), (F.col(at) == F.col("__level")) & (F.col(bucket) == F.col("__heavy")), "left")
        df = df.withColumn("__own", F.pmod(F.xxhash64(*plain), F.coalesce(mine, F.lit(1))))
        df = df.withColumn("__each", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        df = df.withColumn(name, F.coalesce(number(F.col("__own"), F.col("__each")), F.lit(0)))
        return df.drop("__level", "__heavy", "__across", "__down", "__own", "__each")

    visiting = dealt(visiting, "__at", "__bucket", "__across", "__down", lambda own, each: own * F.col("__down") + each, "__tile")
    home = dealt(home, "__home", "__place", "__down", "__across", lambda own, each: each * F.col("__down") + own, "__part")
    return _keyed(visiting, "__at", "__bucket", "__tile", "__key"), _keyed(home, "__home", "__place", "__part", "__lock")


def _keyed(df: DataFrame, at: str, bucket: str, tile: str, name: str) -> DataFrame:
    """One number for a row's place; different places may share it, so their parts are compared as well."""
    return df.withColumn(name, F.xxhash64(at, bucket, tile))


def _meetings(a: DataFrame, b: DataFrame, ends, columns: tuple[dict, dict]) -> list[tuple[DataFrame, DataFrame]]:
    """Rows of both tables in the buckets where spans of the left table meet spans at least as long, and where longer ones
    of the left meet shorter ones; ``__at, __bucket, __first, __tile, __key`` and ``__home, __place, __from, __part, __lock`` tell a row's place."""
    left, right = _spans(a, ends[0], columns[0]), _spans(b, ends[1], columns[1])
    turns = []
    used = (_levels(left), _levels(right))
    for mine, other, levels, equal in ((left, right, used[1], True), (right, left, used[0], False)):
        # each level of the other table not below the row's own; equal levels meet in the first turn only
        if not equal and not any(v > min(used[1], default=ENDLESS) for v in levels):
            break
        visiting = _in_buckets(mine, _looked_into(levels, equal)).drop("__low", "__high", "__level")
        home = _in_buckets(other, F.array("__level")).select(
            *[c for c in other.columns if c not in ("__low", "__high", "__level")],
            F.col("__at").alias("__home"), F.col("__bucket").alias("__place"), F.col("__first").alias("__from"))
        turns.append(_in_tiles(visiting, home))
    return turns


#: Differences, since equalities would become keys of the join.
MEET = "__key = __lock AND __at - __home = 0 AND __bucket - __place = 0 AND __tile - __part = 0"


def _met(turns: list[tuple[DataFrame, DataFrame]], columns: tuple[dict, dict]) -> DataFrame:
    """Pairs of rows whose spans share a bucket on the level of the longer one, each pair once.  Sorted rows of a bucket are
    passed over faster than chains of a hash table; the number of tasks is given, since the work is in the pairs, not in the bytes."""
    pairs = None
    for visiting, home in turns:
        tasks = int(visiting.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = visiting.repartition(tasks, "__key").join(home.repartition(tasks, "__lock").hint("merge"), F.expr(MEET))
        met = met.filter(F.col("__bucket") == F.greatest("__first", "__from"))  # spans that share two buckets
        met = met.select(*columns[0], *columns[1])
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs


def _with_partner(turns: list[tuple[DataFrame, DataFrame]], row: str, condition: Column) -> DataFrame:
    """Numbers of the rows of one side that meet the condition with some row of the other; the first one found is enough."""
    found = []
    for visiting, home in turns:
        mine, other = (visiting, home) if row in visiting.columns else (home, visiting)
        found.append(mine.join(other, F.expr(MEET) & condition, "left_semi").select(row))
    return reduce(DataFrame.unionAll, found).distinct()


def range_join(a: DataFrame, b: DataFrame, condition: str, how: str, names: tuple[str, str], ends) -> DataFrame:
    """The join of two tables (aliased ``names``) on a condition with ``bounds``; columns ``l0.. r0..`` by position.

    An outer join stores the rows of the sides it keeps, numbers them, and adds those without partner.  Those are found
    by a join of their own that ends a row's search at its first partner, so that pairs are neither stored nor shuffled.
    """
    placed = _positional(_qualified(condition, a, b, names), (a.columns, b.columns), names)
    left = {f"l{i}": f"{names[0]}.`{c}`" for i, c in enumerate(a.columns)}
    right = {f"r{i}": f"{names[1]}.`{c}`" for i, c in enumerate(b.columns)}

    def numbered(df: DataFrame, name: str, row: str) -> DataFrame:
        return cut_lineage(df.withColumn(row, F.monotonically_increasing_id())).alias(name)

    if how in ("left", "outer"):
        a, left = numbered(a, names[0], "__row_l"), left | {"__row_l": "__row_l"}
    if how in ("right", "outer"):
        b, right = numbered(b, names[1], "__row_r"), right | {"__row_r": "__row_r"}
    turns = _meetings(a, b, ends, (left, right))
    pairs = _met(turns, (left, right)).filter(placed)
    kept = [c for c in (*left, *right) if not c.startswith("__row_")]
    whole = pairs.select(*kept)
    for side, df, columns, row in (("left", a, left, "__row_l"), ("right", b, right, "__row_r")):
        if how in (side, "outer"):
            alone = df.select(*[F.col(c).alias(n) for n, c in columns.items()]).join(_with_partner(turns, row, placed), row, "left_anti")
            whole = whole.unionByName(alone.drop(row), allowMissingColumns=True)
    return whole.select(*kept)
