"""Jobs over a corpus of tasks: stored chains, model responses, results.

Everything here is an expression on columns: one narrow pass over the corpus,
whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import BLANK
from ..functions.names import as_list, col
from .evaluation import error_type

STEP = "struct<op: string, params: map<string, string>, op_tables: array<string>, table_indices: array<int>>"
CHAIN = f"array<{STEP}>"
BINARY = ("join", "union")

# Marks in responses and in rendered chains.
FENCE = "```"
PYTHON_FENCE = "```python"
INSTRUCTION_MARKS = ("指令:", "Instruction:")
NO_CHAIN = "No transformation operations"
NO_PARAMS = "No parameters"
NO_TABLES = "No tables"
UNKNOWN_OP = "Unknown operation"


# -- chains ------------------------------------------------------------------------
def parse_chain(text: Column) -> Column:
    """Steps of a chain stored as JSON text; unreadable text gives no steps.

    Nested parameters stay JSON text inside ``params``.
    """
    return F.coalesce(F.from_json(text, CHAIN), F.array().cast(CHAIN))


def load_tasks(lines: DataFrame, text: str = "transform_chain_str") -> DataFrame:
    """Corpus lines with ``status`` set and the chain parsed."""
    return lines.withColumn("status", F.lit("success")).withColumn("transform_chain", parse_chain(col(text)))


def _no_value(step: Column, key: str) -> Column:
    value = F.try_element_at(step.getField("params"), F.lit(key))
    return value.isNull() | value.isin("", "{}", "[]", "null")


def drop_empty_steps(chain: Column) -> Column:
    """Without renames that rename nothing and filters that have no condition."""
    idle_rename = lambda s: (s.op == "rename") & _no_value(s, "rename_map")
    idle_filter = lambda s: (s.op == "filter") & _no_value(s, "condition")
    return F.filter(chain, lambda s: ~F.coalesce(idle_rename(s) | idle_filter(s), F.lit(False)))


def kept_table(chain: Column, n_tables: Column) -> Column:
    """Position of the first table a chain without join or union works on.

    Null when all tables stay: there is one only, or they are combined, or none is used.
    """
    combined = F.exists(chain, lambda s: s.op.isin(*BINARY))
    positions = F.sequence(F.lit(1), F.greatest(n_tables.cast("int"), F.lit(1)))
    used = F.filter(positions, lambda i: F.exists(
        chain, lambda s: F.coalesce(F.array_contains(s.op_tables, F.concat(F.lit("table_"), i.cast("string"))), F.lit(False))))
    return F.when((n_tables > 1) & ~combined & (F.size(used) > 0), F.get(used, F.lit(0)) - 1)


def prune_chain(chain: Column, kept: Column) -> Column:
    """Only the steps of the kept table, which becomes ``table_1``."""
    name = F.concat(F.lit("table_"), (kept + 1).cast("string"))
    own = F.filter(chain, lambda s: F.coalesce(F.array_contains(s.op_tables, name), F.lit(False)))
    renamed = F.transform(own, lambda s: F.struct(
        s.op.alias("op"), s.params.alias("params"),
        F.array(F.lit("table_1")).alias("op_tables"), F.array(F.lit(0)).alias("table_indices")))
    return F.when(kept.isNull(), chain).otherwise(renamed)


def _spell(value: Column) -> Column:
    """A scalar of JSON text as Python prints it."""
    return (
        F.when(value == "true", "True").when(value == "false", "False")
        .when(value.isNull() | (value == "null"), "None").otherwise(value)
    )


def _quote(value: Column) -> Column:
    """A text in quotes as Python prints it: double ones only around a single quote without double ones."""
    safe = value
    for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        safe = F.replace(safe, F.lit(plain), F.lit(written))
    double = value.contains("'") & ~value.contains('"')
    return F.when(double, F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _spell_element(value: Column, typed: Column) -> Column:
    """An element of a list; its type tells the text ``"2019"`` from the number."""
    return F.when(F.schema_of_variant(typed) == "STRING", _quote(value)).otherwise(_spell(value))


def _spell_param(value: Column) -> Column:
    listed = F.from_json(value, "array<string>")
    typed = F.when(value.startswith("["), F.try_parse_json(value)).cast("array<variant>")
    mapped = F.from_json(value, "map<string, string>")
    list_text = F.concat(F.lit("["), F.array_join(F.zip_with(listed, typed, _spell_element), ", "), F.lit("]"))
    pairs = F.transform(F.map_entries(mapped), lambda e: F.concat(
        F.lit("'"), e.key, F.lit("': '"), _spell(e.value), F.lit("'")))
    map_text = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    return (
        F.when(value.startswith("["), F.coalesce(list_text, value))
        .when(value.startswith("{"), F.coalesce(map_text, value))
        .otherwise(_spell(value))
    )


def render_chain(chain: Column) -> Column:
    """Numbered lines such as ``1. sort (by: ['a']) (op_tables: table_1)``."""
    def line(step: Column, i: Column) -> Column:
        binary = step.op.isin(*BINARY)
        side = lambda key, at: F.when(binary & (key == at[0]), F.get(step.op_tables, F.lit(at[1])))
        params = F.transform(F.map_entries(step.params), lambda e: F.concat(
            e.key, F.lit(": "),
            F.coalesce(side(e.key, ("left_table", 0)), side(e.key, ("right_table", 1)), _spell_param(e.value))))
        shown = F.when(F.coalesce(F.size(step.params), F.lit(0)) > 0, F.array_join(params, ", ")).otherwise(NO_PARAMS)
        tables = F.when(F.coalesce(F.size(step.op_tables), F.lit(0)) > 0,
                        F.array_join(step.op_tables, ", ")).otherwise(NO_TABLES)
        return F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(step.op, F.lit(UNKNOWN_OP)),
                        F.lit(" ("), shown, F.lit(") (op_tables: "), tables, F.lit(")"))

    return F.when(F.size(chain) > 0, F.array_join(F.transform(chain, line), "\n")).otherwise(NO_CHAIN)


def op_histogram(tasks: DataFrame, chain: str = "transform_chain") -> DataFrame:
    """How often each operator occurs; counted per task file before the shuffle."""
    ops = tasks.select(F.explode(F.col(f"{chain}.op")).alias("op"))
    return ops.groupBy(F.coalesce("op", F.lit("unknown")).alias("op")).count().withColumnRenamed("count", "n")


def chain_size(chain: Column) -> Column:
    return F.when(F.size(chain) == 1, "low").when(F.size(chain) == 2, "medium").otherwise("high")


def chain_buckets(tasks: DataFrame, chain: str = "transform_chain") -> DataFrame:
    sized = tasks.select(chain_size(F.coalesce(col(chain), F.array().cast(CHAIN))).alias("complexity"))
    return sized.groupBy("complexity").count().withColumnRenamed("count", "n")


# -- responses ---------------------------------------------------------------------
def _trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def extract_code(response: Column) -> Column:
    """Inside of the first Python fence, else of the first fence, else the whole text."""
    fenced = rf"(?s){FENCE}(.*?)(?:{FENCE}|\z)"
    python = rf"(?s){PYTHON_FENCE}(.*?)(?:{FENCE}|\z)"
    return _trim(
        F.when(response.contains(PYTHON_FENCE), F.regexp_extract(response, python, 1))
        .when(response.contains(FENCE), F.regexp_extract(response, fenced, 1))
        .otherwise(response)
    )


def extract_instruction(response: Column) -> Column:
    """Text after the first mark, up to the next; the whole text without one."""
    first, second = INSTRUCTION_MARKS
    after = lambda mark: F.get(F.split(response, mark, -1), F.lit(1))
    return _trim(
        F.when(response.contains(first), after(first)).when(response.contains(second), after(second))
        .otherwise(response)
    )


def parse_verdict(text: Column, intent: Column) -> Column:
    """``{is_valid, intent}`` of a JSON verdict; unreadable ones pass with the old intent."""
    readable = F.get_json_object(text, "$").startswith("{")
    valid = F.lower(F.coalesce(F.get_json_object(text, "$.is_valid"), F.lit("false"))) == "true"
    rewritten = F.coalesce(F.get_json_object(text, "$.intent"), intent)
    readable = F.coalesce(readable, F.lit(False))
    return F.struct(
        F.when(readable, valid).otherwise(True).alias("is_valid"),
        F.when(readable, rewritten).otherwise(intent).alias("intent"),
    )


# -- results -----------------------------------------------------------------------
def flatten_results(tasks: DataFrame) -> DataFrame:
    """Fill what is missing in ``execution_result``: status, error, error type, method.

    Expects ``error`` and ``error_type`` columns beside ``execution_result``
    (``status``, ``error``, ``error_type``, ``execution_method``).
    """
    result = F.col("execution_result")
    outer_type = F.coalesce(F.col("error_type"), F.lit("unknown"))
    error = F.coalesce(result.getField("error"), F.col("error"))
    inferred = F.when(F.length(error) > 0, error_type(error)).otherwise(outer_type)
    return tasks.withColumn("execution_result", F.struct(
        F.coalesce(result.getField("status"), F.lit("unknown")).alias("status"),
        error.alias("error"),
        F.when(result.isNull(), outer_type).otherwise(
            F.coalesce(result.getField("error_type"), inferred)).alias("error_type"),
        F.coalesce(result.getField("execution_method"), F.lit("unknown")).alias("execution_method"),
    ))


def table_preview(rows: DataFrame, table: str, order_by: list[str], n: int = 10,
                  chains: DataFrame | None = None) -> DataFrame:
    """First ``n`` rows of every table; with ``chains``, only of tables a step uses.

    The rank limit is applied in every task before the shuffle, so a table that holds
    most rows still sends ``n`` of them per task.
    """
    if chains is not None:
        used = chains.select(F.explode(F.flatten("transform_chain.op_tables")).alias(table)).distinct()
        rows = rows.join(used, table, "left_semi")
    first = Window.partitionBy(col(table)).orderBy(*[col(o).asc_nulls_last() for o in as_list(order_by)])
    return rows.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= n).drop("__n")
