"""What a table looks like, and which operators fit it.

All measures of a column come from one aggregate; the rules are applied to its single
row.  Column names are metadata and are handled while planning.
"""

from __future__ import annotations

import itertools
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.convert import NUMBER_TEXT, to_moment, to_number
from ..functions.names import col, is_present, kind_of
from ..plans.registry import available
from ..session import cut_lineage

# Thresholds, name hints and split characters of the rules.
CATEGORY_RATIO = 0.5
FEW_VALUES = 10
PARSE_SHARE = 0.8
KEY_RATIO = (0.2, 0.8)
TRANSPOSE_HINTS = ("model", "type", "metric", "name")
TRANSPOSE_ROWS = 10
TRANSPOSE_NUMBERS = 3
TRANSPOSE_RATIO = 0.5
SEPARATORS = (" ", "_", "-", ".", "/")

# Column kinds an operator asks for; operators not listed take any table.
NEEDED_KINDS = {"filter": ("numeric", "categorical", "text")}

COLUMNS_AT_ONCE = 8
LISTED = 1_000  # tables in one list of an index
DEALT = 30_000  # columns of a catalogue whose pairs one task counts
FIXED_WIDTH = ("int", "float", "bool", "time")
MEASURES = ("rows", "nulls", "distinct_values", "numbers", "moments", "commas")


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: kind, nulls, distinct values, parseable and comma cells.

    Text is *categorical* when less than half of its cells are distinct.  Each column is scanned once.  Exact counting turns every cell into its column's number, a 128-bit hash and what it can be read as; equal cells are
    counted together before the one shuffle, so neither repeated values nor long texts travel.  ``approximate`` uses
    sketches instead and shuffles one row per task.
    """
    fields = list(enumerate(df.schema.fields))
    return _sketched(df, fields) if approximate else _counted(df, fields)


def _readable(field: T.StructField) -> dict[str, Column]:
    """Whether a cell can be read as a number or a moment, and holds a comma."""
    value, kind, no = col(field.name), kind_of(field.dataType), F.lit(False)
    text = kind == "text"
    moment = no
    if text:
        # most words are told by their first letter: numbers begin with that of inf or nan, moments with that of a month
        first = F.ascii(value)
        named = lambda letters: first.isin(*[ord(c) for c in string.ascii_letters if c.lower() not in letters])
        moment = F.when(named("jfmasondt"), no).otherwise(to_moment(value, field.dataType).isNotNull())
    number = F.when(named("in"), no).otherwise(value.rlike(NUMBER_TEXT)) if text else to_number(value, field.dataType).isNotNull() if kind in ("int", "float", "bool") else no
    return {"numbers": number, "moments": moment,
            "commas": value.contains(",") if text else no}


def _comparable_cell(field: T.StructField) -> Column:
    return F.to_json(col(field.name)) if kind_of(field.dataType) in ("list", "other") else col(field.name)


def _counted(df: DataFrame, fields: list[tuple[int, T.StructField]]) -> DataFrame:
    cells = []
    for i, field in fields:
        there, value = is_present(col(field.name), field.dataType), _comparable_cell(field)
        # hashes of values of eight bytes at most are one to one; others get a second one from another start
        small = kind_of(field.dataType) in FIXED_WIDTH and not isinstance(field.dataType, T.DecimalType)
        second = F.lit(0).cast("bigint") if small else F.xxhash64(F.lit(1), value)
        flags = reduce(Column.__add__, [F.when(c, 2**k).otherwise(0) for k, c in enumerate(_readable(field).values())])
        if kind_of(field.dataType) in ("int", "bool"):
            flags = F.lit(1)
        cells.append(F.when(there, F.struct(F.lit(i).alias("i"), F.xxhash64(value).alias("h"), second.alias("h2"), flags.alias("f"))).otherwise(
            F.struct(F.lit(i).alias("i"), F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("bigint").alias("h2"), F.lit(0).alias("f"))))
    # a scan reads its own columns only, so some columns at a time cost no more than all, and their code stays short
    parts = [df.select(F.inline(F.array(*cells[at:at + COLUMNS_AT_ONCE]))) for at in range(0, len(cells), COLUMNS_AT_ONCE)]
    equal = reduce(DataFrame.unionAll, parts).groupBy("i", "h", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("f"))
    equal = equal.select("*", *[(F.col("f").bitwiseAND(2**k) > 0).alias(m) for k, m in enumerate(MEASURES[3:])])
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("bigint"))
    found = equal.groupBy("i").agg(
        F.sum("n").alias("rows"), count(F.col("h").isNull()).alias("nulls"), F.count("h").alias("distinct_values"),
        *[count(F.col(m)).alias(m) for m in MEASURES[3:]])
    named = [(i, f.name, _label(f), f.dataType.simpleString()) for i, f in fields]
    about = df.sparkSession.createDataFrame(named, "position int, column string, label string, dtype string")
    zero = F.lit(0).cast("bigint")
    line = about.join(found, F.col("position") == F.col("i"), "left").select(
        "position", "column", "label", "dtype", *[F.coalesce(m, zero).alias(m) for m in MEASURES])
    few = F.col("distinct_values") / F.col("rows") < CATEGORY_RATIO
    kind = F.coalesce("label", F.when(few, "categorical").otherwise("text"))
    return line.select("column", "position", kind.alias("kind"), "dtype", *MEASURES)


def _label(field: T.StructField) -> str | None:
    """The kind of a column by its type; text is told by its values."""
    kind = kind_of(field.dataType)
    labels = {"int": "numeric", "float": "numeric", "bool": "numeric", "time": "datetime", "list": "list", "text": None}
    return labels.get(kind, "other")


def _sketched(df: DataFrame, fields: list[tuple[int, T.StructField]]) -> DataFrame:
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, field in fields:
        there = is_present(col(field.name), field.dataType)
        measures += [F.count_if(~there).alias(f"nulls{i}"),
                     F.approx_count_distinct(F.when(there, _comparable_cell(field))).alias(f"distinct_values{i}"),
                     *[F.count_if(c).alias(f"{m}{i}") for m, c in _readable(field).items()]]
    entries = [_entry(i, f, {m: F.col("rows" if m == "rows" else f"{m}{i}") for m in MEASURES}) for i, f in fields]
    return df.agg(*measures).select(F.inline(F.array(*entries)))


def _entry(i: int, field: T.StructField, measured: dict[str, Column]) -> Column:
    """The line of a column in the profile."""
    few = measured["distinct_values"] / measured["rows"] < CATEGORY_RATIO
    named = F.lit(_label(field)) if _label(field) else F.when(few, "categorical").otherwise("text")
    return F.struct(F.lit(field.name).alias("column"), F.lit(i).alias("position"), named.alias("kind"),
                    F.lit(field.dataType.simpleString()).alias("dtype"), *[c.alias(m) for m, c in measured.items()])


def table_flags(profile: DataFrame, columns: list[str]) -> DataFrame:
    """One row of table properties, from a column profile."""
    kind, first = F.col("kind"), F.col("position") == 0
    text_like = kind.isin("categorical", "text")
    measured = profile.agg(
        F.max("rows").alias("n_rows"), F.count("*").alias("n_columns"),
        F.count_if(kind == "numeric").alias("n_numeric"), F.count_if(kind == "categorical").alias("n_categorical"),
        F.count_if(kind == "datetime").alias("n_datetime"), F.count_if(kind == "text").alias("n_text"),
        F.bool_or(kind == "list").alias("has_lists"), F.bool_or(F.col("commas") > 0).alias("has_comma_text"),
        F.bool_or(text_like & (F.col("distinct_values") < FEW_VALUES)).alias("has_pivot_column"),
        F.max(F.when(first, F.col("distinct_values"))).alias("first_distinct"),
        F.max(F.when(first, F.col("nulls"))).alias("first_nulls"),
        F.max(F.when(first, F.col("numbers"))).alias("first_numbers"),
        F.bool_or(castable_condition()).alias("castable"),
    )
    hinted = any(h in columns[0].lower() for h in TRANSPOSE_HINTS)
    unique = (F.col("first_distinct") + F.col("first_nulls") == F.col("n_rows")) & (F.col("first_nulls") <= 1)
    ratio = F.col("first_distinct") / F.col("n_rows")
    return measured.select(
        "n_rows", "n_columns", "n_numeric", "n_categorical", "n_datetime", "n_text", "has_lists", "has_comma_text",
        F.lit(is_wide(columns)).alias("is_wide"),
        (~F.col("has_lists") & ~F.col("has_comma_text") & unique & (F.col("n_rows") < TRANSPOSE_ROWS)
         & (F.lit(hinted) | (ratio > TRANSPOSE_RATIO)) & (F.col("first_numbers") <= TRANSPOSE_NUMBERS)
         ).alias("can_transpose"),
        ((F.col("n_columns") > 1) & (F.col("n_rows") > 1)).alias("can_groupby"),
        ((F.col("n_numeric") >= 1) & (F.col("n_categorical") >= 2) & (F.col("n_columns") >= 3)
         & F.col("has_pivot_column")).alias("can_pivot"),
        "castable",
    )


# -- casts -------------------------------------------------------------------------
def _cast_rules() -> list[tuple[Column, str]]:
    kind, dtype = F.col("kind"), F.col("dtype")
    # missing text cells read as NaN count as numbers, as they do in a data frame
    number_share = (F.col("numbers") + F.col("nulls")) / F.col("rows")
    moment_share = F.col("moments") / (F.col("rows") - F.col("nulls"))
    whole = dtype.isin("tinyint", "smallint", "int", "bigint")
    return [
        (kind == "numeric", "str"),
        ((kind == "text") & (number_share > PARSE_SHARE), "float"),
        (kind == "datetime", "str"),
        ((kind == "text") & (moment_share > PARSE_SHARE), "datetime64"),
        ((kind == "numeric") & whole, "float"),
        ((kind == "numeric") & (dtype.isin("float", "double") | dtype.startswith("decimal")), "int"),
        (kind == "categorical", "str"),
    ]


def castable_condition() -> Column:
    rules = [F.coalesce(rule, F.lit(False)) for rule, _ in _cast_rules()]
    return F.exists(F.array(*rules), lambda r: r)


def castable_columns(profile: DataFrame) -> DataFrame:
    """Pairs of column and target type that a cast makes sense for."""
    targets = F.array(*[F.when(rule, F.lit(target)) for rule, target in _cast_rules()])
    listed = profile.select("column", F.explode(targets).alias("dtype_to"))
    return listed.filter(F.col("dtype_to").isNotNull())


# -- names -------------------------------------------------------------------------
def _words(name: str) -> tuple[str, ...]:
    """A name cut at separators and between digits and anything else."""
    blanked = re.sub("[" + re.escape("".join(SEPARATORS)) + "]", "\0", name)
    return tuple(re.findall(r"[0-9]+|[^0-9\0]+", blanked))


def wide_name_pairs(columns: list[str]) -> list[tuple[str, str, int]]:
    """Pairs of name endings that share two or more name beginnings.

    Only endings that occur behind the same beginning are paired."""
    endings: dict[tuple, dict[tuple, None]] = defaultdict(dict)  # ordered sets
    for words in map(_words, columns):
        for cut in range(1, len(words)):
            endings[words[:cut]][words[cut:]] = None
    shared = Counter(pair for behind in endings.values() for pair in itertools.combinations(behind, 2))
    total: Counter = Counter()
    for (a, b), n in shared.items():
        total[(b, a) if (b, a) in total else (a, b)] += n
    return [("_".join(a), "_".join(b), n) for (a, b), n in total.items() if n >= 2]


def is_wide(columns: list[str]) -> bool:
    return bool(wide_name_pairs(columns))


def _readings(columns: list[str]) -> list[dict]:
    """Every reading of a name as stub, separator and ending: at the last of each separator in it,
    or, in a name without any, where letters pass into a final number."""
    found = []
    for name in columns:
        parted = [name.rpartition(sep) for sep in SEPARATORS if sep in name]
        number = re.search("[0-9]+$", name)
        if not parted and number and re.fullmatch(r"[A-Za-z\s]+", name[:number.start()]):
            parted = [(name[:number.start()].strip(), "", number[0])]
        found += [{"name": name, "stub": stub, "sep": sep, "ending": ending} for stub, sep, ending in parted]
    return found


def infer_wide_to_long(columns: list[str]) -> dict:
    """Parameters for ``wide_to_long`` read off the column names.

    The stub or ending that goes with most different others, under one separator, is the
    sub-name; stubs win ties.  Columns without it identify the rows.
    """
    nothing = {"subnames": [], "i": list(columns), "j": "var", "sep": "", "suffix": ""}
    readings = _readings(columns)
    partners: dict[str, dict[tuple, set]] = {"stub": defaultdict(set), "ending": defaultdict(set)}
    for side, other in (("stub", "ending"), ("ending", "stub")):
        for r in readings:
            partners[side][r[side], r["sep"]].add(r[other])
    most = {side: max((len(p) for p in known.values()), default=0) for side, known in partners.items()}
    side = max(most, key=most.get)
    if most[side] < 2:
        return nothing
    best = [key for key, others in partners[side].items() if len(others) == most[side]]
    sep = best[-1][1]
    subnames = list(dict.fromkeys(part.strip() for part, _ in best if part.strip()))

    def measured(name: str) -> bool:
        for sub in subnames:
            marked = f"{sub}{sep}" if side == "stub" else f"{sep}{sub}"
            rest = name.removeprefix(marked) if side == "stub" else name.removesuffix(marked)
            if rest != name and (sep or (rest.isdigit() if side == "stub" else rest.isalpha())):
                return True
        return False

    return {"subnames": subnames, "i": [c for c in columns if not measured(c)], "j": "var", "sep": sep, "suffix": r"\w+"} if subnames else nothing


# -- operators ---------------------------------------------------------------------
def compatible_ops(flags: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Operators that fit the table the flags describe, one row each; custom ones
    included, unless ``names`` says which to look at."""
    special = {
        "explode": F.col("has_lists") | F.col("has_comma_text"),
        "wide_to_long": F.col("is_wide"),
        "pivot": F.col("can_pivot"),
        "unpivot": F.col("n_columns") >= 3,
        "transpose": F.col("can_transpose"),
        "groupby": F.col("can_groupby"),
        "cast": F.col("castable"),
    }
    checks = []
    for name in sorted(available() if names is None else names):
        fits = special.get(name, F.lit(True))
        if name in NEEDED_KINDS:
            fits = F.greatest(*[F.col(f"n_{kind}") for kind in NEEDED_KINDS[name]]) > 0
        checks.append(F.when(fits, F.lit(name)))
    return flags.select(F.explode(F.array_compact(F.array(*checks))).alias("op"))


def join_possible(left: DataFrame, right: DataFrame) -> bool:
    """Some shared names, and equal types in all of them."""
    shared = set(left.columns) & set(right.columns)
    return bool(shared) and all(left.schema[c].dataType == right.schema[c].dataType for c in shared)


def union_possible(left: DataFrame, right: DataFrame) -> bool:
    """The same names, types and column order."""
    return [(f.name, f.dataType) for f in left.schema] == [(f.name, f.dataType) for f in right.schema]


def table_pairs(catalogue: DataFrame) -> DataFrame:
    """``(one, two, shared, joins, unions)`` of all pairs of tables in a catalogue that can be joined or unioned.

    ``catalogue`` has a row for each column: ``table``, ``position``, ``column``, ``dtype``.  Tables meet through an index of their
    column names, so pairs without a common name are never looked at.  A join needs equal types in all shared names, a
    union the same columns in the same order; ``one`` is the lesser name.  The tables that know a name or a layout travel to each
    of these tables as lists, one for a type, of ``LISTED`` on average at most; pairs are made and counted where the lists of
    their first table are, and not moved.
    """
    own = catalogue.groupBy("table").agg(
        F.array_sort(F.collect_list(F.struct("position", "column", "dtype"))).alias("columns"))
    layout = F.to_json(F.transform("columns", lambda c: F.struct(c["column"], c["dtype"])))
    alike = own.select("table", F.md5(layout.cast("binary")).alias("key"), F.lit("").alias("dtype"), F.lit(True).alias("whole"))
    known = catalogue.select("table", F.col("column").alias("key"), "dtype", F.lit(False).alias("whole")).unionByName(alike)
    known = cut_lineage(known)
    many = known.groupBy("whole", "key").count().filter(F.col("count") > LISTED)
    block = F.pmod(F.xxhash64("table"), F.floor(F.coalesce("count", F.lit(0)) / LISTED) + 1)
    placed = known.join(many, ["whole", "key"], "left").withColumn("block", block)
    lists = placed.groupBy("whole", "key", "dtype", "block").agg(F.sort_array(F.collect_list("table")).alias("others"))
    met = known.join(lists.withColumnRenamed("dtype", "other"), ["whole", "key"]).select(
        F.col("table").alias("one"), "whole", F.when(~F.col("whole"), F.col("dtype") == F.col("other")).alias("same"),
        F.filter("others", lambda t: t > F.col("table")).alias("others"))
    # pairs are many times their lists, so the lists are dealt over as many tasks as the catalogue needs
    width = max(int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions")), known.count() // DEALT)
    met = met.filter(F.size("others") > 0).repartition(width, "one")
    pairs = met.select("one", "whole", "same", F.explode("others").alias("two"))
    counted = pairs.groupBy("one", "two").agg(
        F.count_if(~F.col("whole")).alias("shared"), F.bool_and("same").alias("joins"), F.bool_or("whole").alias("unions"))
    return counted.filter((F.col("joins") | F.col("unions")) & (F.col("shared") > 0))


def catalogue_name_pairs(catalogue: DataFrame) -> DataFrame:
    """``(table, one, two, beginnings)``: what ``wide_name_pairs`` finds, for all tables of a catalogue (``table``, ``column``) at once.

    Names are cut into words, and each beginning of a name lists the endings behind it; ``one`` is the lesser ending.
    Pairs arise within one beginning of one table only, so a table's names are brought together once, and tables are dealt over as
    many tasks as the catalogue needs.
    """
    width = max(int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions")), catalogue.count() // DEALT)
    catalogue = catalogue.select("table", "column").repartition(width, "table")
    words = F.regexp_extract_all(F.regexp_replace("column", "[" + re.escape("".join(SEPARATORS)) + "]", " "), F.lit("([0-9]+|[^0-9 ]+)"), 1)
    cut = catalogue.select("table", words.alias("w")).filter(F.size("w") > 1)
    cut = cut.select("table", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("at"))
    parts = cut.select("table", F.slice("w", F.lit(1), F.col("at")).alias("beginning"),
                       F.slice("w", F.col("at") + 1, F.size("w")).alias("ending")).distinct()
    behind = parts.groupBy("table", "beginning").agg(F.array_sort(F.collect_set("ending")).alias("endings")).filter(F.size("endings") > 1)
    ones = behind.select("table", "beginning", "endings", F.posexplode("endings").alias("at", "one"))
    pairs = ones.select("table", "beginning", "one", F.explode(F.slice("endings", F.col("at") + 2, F.size("endings"))).alias("two"))
    counted = pairs.groupBy("table", "one", "two").agg(F.count("*").alias("beginnings")).filter(F.col("beginnings") >= 2)
    return counted.select("table", F.array_join("one", "_").alias("one"), F.array_join("two", "_").alias("two"), "beginnings")


def pair_operations(tables: dict[str, DataFrame], join_columns: dict[str, str] | None = None) -> list[dict]:
    """Joins and unions possible between the tables; needs their schemas only."""
    known, found = join_columns or {}, []
    for (a, left), (b, right) in itertools.combinations(tables.items(), 2):
        if join_possible(left, right) or (a in known and b in known):
            found.append({"op": "join", "tables": [a, b], "on": join_key(left, right, known.get(a), known.get(b))})
        if union_possible(left, right):
            found.append({"op": "union", "tables": [a, b]})
    return found


def join_key(left: DataFrame, right: DataFrame, left_on: str | None = None,
             right_on: str | None = None) -> tuple[str, str]:
    """Known foreign-key columns, else the first shared column."""
    if left_on and right_on:
        return left_on, right_on
    shared = [c for c in left.columns if c in set(right.columns)]
    return shared[0], shared[0]


def split_keys(profile: DataFrame) -> DataFrame:
    """Columns that repeat often enough, and not too often, to split a table by."""
    ratio = F.col("distinct_values") / F.col("rows")
    return profile.filter((ratio > KEY_RATIO[0]) & (ratio < KEY_RATIO[1])).select("column", ratio.alias("ratio"))
