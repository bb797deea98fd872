"""The graph of tables linked by keys; here, keys of the given tables stand for tables."""

from pyspark.sql import functions as F

from rowwright.jobs import keygraph

from .registry import query


def order_links(t):
    return t("orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("o"), "o_orderkey").alias("b"))


@query("""SELECT 'c' || o_custkey AS component, count(*) + 1 AS tables FROM orders GROUP BY o_custkey""")
def fk_component_sizes(t):
    return keygraph.component_sizes(keygraph.components(order_links(t)))


# suppliers and parts of all line items: links of several hops; DuckDB follows them step by step
@query("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
n AS (SELECT DISTINCT a AS node FROM g),
r AS (SELECT (SELECT min(node) FROM n) AS node UNION SELECT g.b FROM r JOIN g ON r.node = g.a)
SELECT node, (SELECT min(node) FROM n) AS component FROM r""")
def fk_components(t):
    links = t("lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    return keygraph.components(links)


@query("""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
d AS (SELECT a, b, ('0x' || substr(md5('1:' || a || '>' || b), 1, 8))::BIGINT AS h FROM g),
least AS (SELECT a, unnest(list(b ORDER BY h, b)[:2]) AS c FROM d GROUP BY a),
p AS (SELECT g.a AS start, g.a || '>' || g.b || '>' || c AS path FROM g JOIN least ON least.a = g.b WHERE c <> g.a)
SELECT start, replace(arg_min(path, ('0x' || substr(md5('1:' || path), 1, 8))::BIGINT), '>', '/') AS path FROM p GROUP BY start""")
def fk_paths(t):
    links = t("lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    return keygraph.key_paths(links, 3, 1).select("start", F.array_join("path", "/").alias("path"))


# a customer without orders ends a walk of four tables that comes from another customer of the nation
@query("""WITH e AS (SELECT 'n' || c_nationkey AS a, 'c' || c_custkey AS b FROM customer
 UNION ALL SELECT DISTINCT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
p3 AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM g x JOIN g y ON x.b = y.a WHERE x.a <> y.b)
SELECT DISTINCT p AS start, 4::BIGINT AS tables, 3::BIGINT AS links FROM p3 JOIN g ON r = g.a WHERE g.b NOT IN (p, q)""")
def fk_paths_dead_ends(t):
    """Starts of paths of four tables, with the different tables and the links found on the path given."""
    links = t("customer").select(F.concat(F.lit("n"), "c_nationkey").alias("a"), F.concat(F.lit("c"), "c_custkey").alias("b")).unionAll(
        t("orders").select(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey")))
    paths = keygraph.key_paths(links, 4, 2)
    steps = paths.select("start", F.array_distinct("path").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    steps = steps.select("start", F.size("path").cast("bigint").alias("tables"), F.get("path", "i").alias("x"), F.get("path", F.col("i") + 1).alias("y"))
    steps = steps.withColumns({"a": F.greatest("x", "y"), "b": F.least("x", "y")})
    known = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return steps.join(known, ["a", "b"]).groupBy("start", "tables").agg(F.count("*").alias("links"))


# one component of several hops per nation of the supplier
@query("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || s_nationkey || '-' || l_partkey AS b
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
s AS (SELECT DISTINCT g.a AS x, h.b AS y FROM g JOIN g h ON g.b = h.a WHERE g.a LIKE 's%'),
r AS (SELECT DISTINCT x AS root, x AS node FROM s UNION SELECT root, y FROM r JOIN s ON node = x),
c AS (SELECT node, min(root) AS least FROM r GROUP BY node),
m AS (SELECT least, min(b) AS part FROM c JOIN e ON node = a GROUP BY least),
k AS (SELECT least, least(part, least) AS component FROM m)
SELECT node, component FROM c JOIN k USING (least)
UNION SELECT b, component FROM e JOIN c ON node = a JOIN k USING (least)""")
def fk_components_by_nation(t):
    links = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "s_nationkey", F.lit("-"), "l_partkey").alias("b"))
    return keygraph.components(links)


@query("""SELECT 'c' || o_custkey || '-' || 'o' || o_orderkey AS link, 'c_custkey' AS a_column, 'o_custkey' AS b_column FROM orders""")
def fk_join_columns(t):
    """The key columns of paths of two tables that start at an order's customer side."""
    links = order_links(t).withColumns({"a_column": F.lit("c_custkey"), "b_column": F.lit("o_custkey")})
    paths = links.select(F.col("b").alias("start"), F.array("a", "b").alias("path"))
    found = keygraph.path_columns(paths, links)
    return found.select(F.concat_ws("-", "a", "b").alias("link"), "a_column", "b_column")
