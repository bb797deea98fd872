"""Scores over a table of task results."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Difficulty by number of steps, and chain sizes by length.
EASY_UP_TO, MEDIUM_UP_TO = 3, 6

# Error families in the order they are tried, each with the words that
# name it, its finer labels with their words in order, and the label when none hits.
ERROR_FAMILIES = (
    (("parsing failed", "content parsing", "parse", "parsing"), (
        ("parsing_format_error", ("format", "structure")),
        ("parsing_syntax_error", ("syntax", "field")),
        ("parsing_empty_error", ("empty content", "empty")),
    ), "parsing_general_error"),
    (("execution failed", "pipeline execution", "execution", "running"), (
        ("execution_param_error", ("parameter", "param")),
        ("execution_type_error", ("type", "conversion")),
        ("execution_table_error", ("table", "data")),
        ("execution_op_error", ("operator", "operation", "op")),
        ("execution_invalid_result_error", ("invalid execution table", "no valid table")),
    ), "execution_general_error"),
    (("validation failed", "mismatch", "validation"), (
        ("validation_schema_error", ("schema", "column", "field")),
        ("validation_content_error", ("content", "value")),
        ("validation_size_error", ("size", "row", "column count")),
    ), "validation_general_error"),
    (("input table", "input", "failed to read target"), (
        ("input_missing_error", ("missing", "not found")),
        ("input_format_error", ("format", "invalid input")),
        ("input_intent_missing_error", ("user intent not found",)),
    ), "input_general_error"),
    (("model call failed", "model", "llm"), (
        ("model_timeout_error", ("timeout",)),
        ("model_empty_response_error", ("empty response", "empty")),
        ("model_format_error", ("format",)),
        ("model_connection_error", ("connection", "network")),
    ), "model_general_error"),
    (("operation chain is empty", "operation transformation failed", "transform", "chain"), (
        ("chain_empty_error", ("operation chain is empty",)),
        ("chain_length_error", ("length mismatch", "length")),
        ("chain_param_error", ("parameter", "param")),
        ("chain_order_error", ("order", "sequence")),
        ("chain_op_mismatch_error", ("mismatch", "operation mismatch")),
    ), "chain_general_error"),
    (("read file", "file", "io", "save"), (
        ("io_read_error", ("read", "load")),
        ("io_write_error", ("write", "save")),
        ("io_not_found_error", ("not found", "not exist")),
        ("io_permission_error", ("permission", "access")),
    ), "io_general_error"),
)
UNKNOWN_ERROR = "unknown_error"


def _mentions(message: Column, words: tuple[str, ...]) -> Column:
    return reduce(operator.or_, [message.contains(w) for w in words])


def error_type(message: Column) -> Column:
    """Class of an error message: first family whose words occur, then its first label."""
    lowered = F.lower(message)
    result = None
    for words, labels, otherwise in ERROR_FAMILIES:
        inner = None
        for label, hints in labels:
            hit = _mentions(lowered, hints)
            inner = F.when(hit, label) if inner is None else inner.when(hit, label)
        family = _mentions(lowered, words)
        inner = inner.otherwise(otherwise)
        result = F.when(family, inner) if result is None else result.when(family, inner)
    return result.otherwise(UNKNOWN_ERROR)


def difficulty(complexity: Column) -> Column:
    return (
        F.when((complexity >= 1) & (complexity <= EASY_UP_TO), "easy")
        .when((complexity > EASY_UP_TO) & (complexity <= MEDIUM_UP_TO), "medium")
        .otherwise("hard")
    )


def status_of(timed_out: Column, error: Column, difference: Column) -> Column:
    """Status of a run from what is stored about it."""
    return (
        F.when(timed_out, "timeout").when(error.isNotNull(), "error")
        .when(difference.isNotNull(), "partial").otherwise("success")
    )


def run_summary(tasks: DataFrame, status: str = "status", seconds: str = "exec_time") -> DataFrame:
    """Totals of a run: tasks, successes, failures, success rate, total and mean time."""
    done = F.count_if(F.col(status) == "success")
    n = F.count(F.lit(1))
    time = F.coalesce(F.sum(seconds), F.lit(0))
    safe = F.nullif(n, F.lit(0))
    return tasks.agg(
        n.alias("total_tasks"), done.alias("successful_tasks"), (n - done).alias("failed_tasks"),
        F.coalesce(done / safe, F.lit(0.0)).alias("success_rate"),
        time.cast("double").alias("total_time"), F.coalesce(time / safe, F.lit(0.0)).cast("double").alias("avg_time"),
    )


def accuracy_by_difficulty(tasks: DataFrame) -> DataFrame:
    """Per difficulty and overall: share of right results, and share of runs that gave any."""
    right = F.count_if(F.col("status") == "success")
    ran = F.count_if(F.col("status").isin("success", "partial"))
    n = F.count(F.lit(1))
    grouped = tasks.rollup("difficulty").agg(
        F.grouping("difficulty").alias("is_total"), n.alias("tasks"),
        (right * 100 / n).alias("execution_accuracy"), (ran * 100 / n).alias("program_validity"),
    )
    label = F.when(F.col("is_total") == 1, "overall").otherwise(F.coalesce("difficulty", F.lit("unknown")))
    return grouped.select(label.alias("difficulty"), "tasks", "execution_accuracy", "program_validity")


def operator_overlap(predicted: Column, target: Column) -> Column:
    """Share of the target's operators found in the prediction, each as often as it occurs.

    Our own reading of operator accuracy, which has no published definition.
    """
    def times(ops: Column, op: Column) -> Column:
        return F.size(F.filter(ops, lambda x: x == op))

    shared = F.aggregate(
        F.array_distinct(target), F.lit(0),
        lambda total, op: total + F.least(times(predicted, op), times(target, op)),
    )
    return F.when(F.size(target) > 0, shared / F.size(target))
