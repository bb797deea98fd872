"""Stored chains and model responses; built from events, documents and conversations."""

from pyspark.sql import functions as F

from rowwright.jobs import corpus

from .registry import query


def chain_texts(t):
    """Two or three steps per event as JSON text; every eleventh text is cut short."""
    text = F.format_string(
        '[{"op": "filter", "params": {"condition": "%s"}, "op_tables": ["table_2"], "table_indices": [1]},'
        ' {"op": "rename", "params": {"rename_map": %s}, "op_tables": ["table_1"], "table_indices": [0]},'
        ' {"op": "sort", "params": {"by": ["%s", "b"], "ascending": [true, false]}, "op_tables": ["table_2"], "table_indices": [1]}]',
        F.expr("if(event_id % 2 = 0, '', concat('x > ', user_id))"),
        F.expr("if(event_id % 3 = 0, '{}', '{\"a\": \"c\"}')"), F.col("event_type"))
    return t("events").select("event_id", F.when(F.col("event_id") % 11 == 0, F.substring(text, 1, 40)).otherwise(text).alias("transform_chain_str"))


def chains(t):
    return corpus.load_tasks(chain_texts(t))


@query("""SELECT event_id, 'success' AS status, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 3 END::BIGINT AS steps,
 CASE WHEN event_id % 11 <> 0 THEN '["' || event_type || '","b"]' END AS sort_by FROM events""")
def parse_chain(t):
    return chains(t).select(
        "event_id", "status", F.size("transform_chain").cast("bigint").alias("steps"),
        F.get("transform_chain", F.lit(2)).getField("params")["by"].alias("sort_by"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE array_to_string(list_filter([
 CASE WHEN event_id % 2 <> 0 THEN 'filter' END, CASE WHEN event_id % 3 <> 0 THEN 'rename' END, 'sort'], lambda x: x IS NOT NULL), '+') END AS ops
FROM events""")
def normalise_chain(t):
    kept = corpus.drop_empty_steps(F.col("transform_chain"))
    return chains(t).select("event_id", F.array_join(kept.getField("op"), "+").alias("ops"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 <> 0 THEN 0 ELSE 1 END::BIGINT AS kept,
 CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 3 <> 0 THEN 'rename@table_1'
  WHEN event_id % 2 <> 0 THEN 'filter@table_1+sort@table_1' ELSE 'sort@table_1' END AS ops FROM events""")
def prune_chain(t):
    cleaned = chains(t).withColumn("chain", corpus.drop_empty_steps(F.col("transform_chain")))
    kept = cleaned.withColumn("kept", corpus.kept_table(F.col("chain"), F.lit(2)))
    pruned = kept.withColumn("chain", corpus.prune_chain(F.col("chain"), F.col("kept")))
    shown = F.transform("chain", lambda s: F.concat(s.op, F.lit("@"), F.get(s.op_tables, F.lit(0))))
    return pruned.select("event_id", F.col("kept").cast("bigint").alias("kept"), F.array_join(shown, "+").alias("ops"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'No transformation operations' ELSE
 '1. filter (condition: ' || CASE WHEN event_id % 2 = 0 THEN '' ELSE 'x > ' || user_id END || ') (op_tables: table_2)' || chr(10) ||
 '2. rename (rename_map: ' || CASE WHEN event_id % 3 = 0 THEN '{}' ELSE '{''a'': ''c''}' END || ') (op_tables: table_1)' || chr(10) ||
 '3. sort (by: [''' || event_type || ''', ''b''], ascending: [True, False]) (op_tables: table_2)' END AS lines FROM events""")
def render_chain(t):
    return chains(t).select("event_id", corpus.render_chain(F.col("transform_chain")).alias("lines"))


BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def trimmed(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '\A{BLANKS}', ''), '{BLANKS}\z', '')"


@query(rf"SELECT conv_id, turn, {trimmed('text')} AS code FROM conversations")
def extract_code(t):
    fence = "```"
    wrapped = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit(f"Here it is:\n{fence}python\n"), "text", F.lit(f"\n{fence}\nDone.")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit(f"{fence}\n"), "text", F.lit(f"\n{fence}")))
        .otherwise(F.concat(F.lit(" "), "text")))
    return t("conversations").select("conv_id", "turn", corpus.extract_code(wrapped).alias("code"))


@query(rf"SELECT conv_id, turn, {trimmed('text')} AS instruction FROM conversations")
def extract_instruction(t):
    wrapped = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Sure.\nInstruction: "), "text"))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("指令:"), "text"))
        .otherwise(F.col("text")))
    return t("conversations").select("conv_id", "turn", corpus.extract_instruction(wrapped).alias("instruction"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS is_valid,
 CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'better ' || text WHEN 2 THEN text ELSE text END AS intent FROM conversations""")
def parse_verdict(t):
    verdict = (
        F.when(F.col("turn") % 4 == 0, F.lit('{"is_valid": "True"}'))
        .when(F.col("turn") % 4 == 1, F.to_json(F.struct(F.lit(False).alias("is_valid"), F.concat(F.lit("better "), "text").alias("intent"))))
        .when(F.col("turn") % 4 == 2, F.lit("not json"))
        .otherwise(F.lit("{}")))
    return t("conversations").select("conv_id", "turn", corpus.parse_verdict(verdict, F.col("text")).alias("v")).select(
        "conv_id", "turn", "v.is_valid", "v.intent")


# "first rows of every table" is the feature; the tables are the suppliers' line items
@query("""SELECT 'table_' || l_suppkey AS name, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) <= 10""")
def table_preview(t):
    rows = t("lineitem").select(
        F.concat(F.lit("table_"), "l_suppkey").alias("name"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    first = corpus.table_preview(rows, "name", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"])
    return first.drop("l_extendedprice")


@query("""SELECT name, event_id FROM (SELECT 'table_' || user_id AS name, event_id FROM events) WHERE name IN ('table_1', 'table_2')
QUALIFY row_number() OVER (PARTITION BY name ORDER BY event_id) <= 5""")
def table_preview_used(t):
    rows = t("events").select(F.concat(F.lit("table_"), "user_id").alias("name"), "event_id")
    return corpus.table_preview(rows, "name", ["event_id"], 5, chains=chains(t))
