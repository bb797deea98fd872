"""Scores over task results; the tasks are derived from the events."""

from pyspark.sql import functions as F

from rowwright.jobs import corpus, evaluation

from .registry import query

# What each kind of event stands for.
STATUS = "CASE event_type WHEN 'click' THEN 'partial' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'timeout' ELSE 'success' END"
PHRASES = ("Parsing failed: bad structure", "Content parsing hit empty content", "Pipeline execution stopped: wrong parameter",
           "Execution failed in operator", "Validation failed: column mismatch", "mismatch of row counts", "Input table not found",
           "Model call failed: timeout", "operation chain is empty", "transform chain length mismatch",
           "read file: permission denied", "cannot save", "something else", "")


def tasks(t):
    return t("events").select(
        "event_id", "user_id", F.expr(STATUS).alias("status"), F.col("value").cast("decimal(18,2)").alias("exec_time"),
        evaluation.difficulty(1 + F.col("user_id") % 8).alias("difficulty"))


TASKS = f"""(SELECT event_id, user_id, {STATUS} AS status, value::DECIMAL(18,2) AS exec_time,
 CASE WHEN user_id % 8 < 3 THEN 'easy' WHEN user_id % 8 < 6 THEN 'medium' ELSE 'hard' END AS difficulty FROM events)"""


@query(f"""SELECT count(*) AS total_tasks, count(*) FILTER (status = 'success') AS successful_tasks,
 count(*) FILTER (status <> 'success') AS failed_tasks, count(*) FILTER (status = 'success') / count(*) AS success_rate,
 sum(exec_time)::DOUBLE AS total_time, sum(exec_time)::DOUBLE / count(*) AS avg_time FROM {TASKS}""")
def run_summary(t):
    return evaluation.run_summary(tasks(t))


@query(f"SELECT status, difficulty, count(*) AS n FROM {TASKS} GROUP BY status, difficulty")
def run_status(t):
    found = t("events").select(
        evaluation.status_of(
            F.col("event_type") == "signup", F.when(F.col("event_type") == "error", "failed"),
            F.when(F.col("event_type") == "click", "differs")).alias("status"),
        evaluation.difficulty(1 + F.col("user_id") % 8).alias("difficulty"))
    return found.groupBy("status", "difficulty").agg(F.count("*").alias("n"))


@query(f"""SELECT coalesce(difficulty, 'overall') AS difficulty, count(*) AS tasks,
 count(*) FILTER (status = 'success') * 100 / count(*) AS execution_accuracy,
 count(*) FILTER (status IN ('success', 'partial')) * 100 / count(*) AS program_validity
FROM {TASKS} GROUP BY ROLLUP (difficulty)""")
def accuracy_by_difficulty(t):
    return evaluation.accuracy_by_difficulty(tasks(t))


def error_type_sql(message: str) -> str:
    """The rule table as a nested CASE."""
    def hit(words):
        return "(" + " OR ".join(f"contains(lower({message}), '{w}')" for w in words) + ")"
    families = []
    for words, labels, otherwise in evaluation.ERROR_FAMILIES:
        inner = " ".join(f"WHEN {hit(h)} THEN '{label}'" for label, h in labels)
        families.append(f"WHEN {hit(words)} THEN CASE {inner} ELSE '{otherwise}' END")
    return f"CASE {' '.join(families)} ELSE '{evaluation.UNKNOWN_ERROR}' END"


PHRASE_LIST = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"


@query(f"""SELECT {error_type_sql('message')} AS error_type, count(*) AS n
FROM (SELECT {PHRASE_LIST}[1 + user_id % {len(PHRASES)}] || ' ' || event_id AS message FROM events) GROUP BY 1""")
def error_types(t):
    phrases = F.array(*[F.lit(p) for p in PHRASES])
    message = F.concat(F.get(phrases, (F.col("user_id") % len(PHRASES)).cast("int")), F.lit(" "), F.col("event_id"))
    return t("events").groupBy(evaluation.error_type(message).alias("error_type")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {error_type_sql('text')} AS error_type FROM documents")
def error_types_of_texts(t):
    return t("documents").select("doc_id", evaluation.error_type(F.col("text")).alias("error_type"))


# chains of one to four steps, as JSON text
OPS = ("filter", "groupby", "sort", "join", "rename")
N_STEPS = "1 + user_id % 4"


def step_op(i):
    return f"CASE (event_id + {i}) % 5 " + " ".join(f"WHEN {k} THEN '{op}'" for k, op in enumerate(OPS)) + " END"


CHAIN_OPS = "list_slice([" + ", ".join(step_op(i) for i in range(4)) + f"], 1, {N_STEPS})"


def chained(t):
    ops = F.slice(F.array(*[F.expr(step_op(i)) for i in range(4)]), 1, (1 + F.col("user_id") % 4).cast("int"))
    steps = F.transform(ops, lambda op: F.struct(op.alias("op"), F.create_map(F.lit("k"), F.lit("1")).alias("params")))
    text = t("events").select("event_id", "user_id", F.to_json(steps).alias("transform_chain_str"))
    return corpus.load_tasks(text)


@query(f"SELECT unnest({CHAIN_OPS}) AS op, count(*) AS n FROM events GROUP BY 1")
def op_histogram(t):
    return corpus.op_histogram(chained(t))


@query(f"SELECT CASE {N_STEPS} WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS complexity, count(*) AS n FROM events GROUP BY 1")
def chain_buckets(t):
    return corpus.chain_buckets(chained(t))


@query(f"""SELECT event_id, list_sum([least(len(list_filter(p, lambda x: x = o)), len(list_filter(q, lambda x: x = o))) FOR o IN list_distinct(q)]) / len(q) AS operator_accuracy
FROM (SELECT event_id, {CHAIN_OPS} AS q, [{step_op(1)}, {step_op(1)}, 'sort'] AS p FROM events)""")
def op_overlap(t):
    predicted = F.array(F.expr(step_op(1)), F.expr(step_op(1)), F.lit("sort"))
    return chained(t).select("event_id", evaluation.operator_overlap(
        predicted, F.col("transform_chain.op")).alias("operator_accuracy"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE lower(event_type) END AS status,
 CASE WHEN event_id % 3 = 0 THEN 'read file: not found' WHEN event_id % 4 = 0 THEN 'outer trouble' END AS error,
 CASE WHEN event_id % 5 = 0 THEN 'given' WHEN event_id % 3 = 0 THEN 'io_read_error'
  WHEN event_id % 4 = 0 THEN 'unknown_error' ELSE 'given' END AS error_type,
 CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'pipeline' END AS execution_method
FROM (SELECT event_id, event_type FROM events)""".replace(
    "CASE WHEN event_id % 3 = 0 THEN 'read file: not found' WHEN",
    "CASE WHEN event_id % 5 <> 0 AND event_id % 3 = 0 THEN 'read file: not found' WHEN"))
def flatten_results(t):
    rows = t("events").select(
        "event_id", F.expr("case when event_id % 4 = 0 then 'outer trouble' end").alias("error"),
        F.lit("given").alias("error_type"),
        F.when(F.col("event_id") % 5 != 0, F.struct(
            F.lower("event_type").alias("status"),
            F.expr("case when event_id % 3 = 0 then 'read file: not found' end").alias("error"),
            F.lit(None).cast("string").alias("error_type"), F.lit("pipeline").alias("execution_method"),
        )).alias("execution_result"))
    return corpus.flatten_results(rows).select("event_id", "execution_result.*")
