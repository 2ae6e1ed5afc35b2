"""Queries over graphs made of the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph


def _t(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tag(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column))


def _nodes(spark, sf) -> DataFrame:
    """Regions, nations, customers, suppliers, parts."""
    parts = [("r", "region", "r_regionkey", "r_name"), ("n", "nation", "n_nationkey", "n_name"), ("c", "customer", "c_custkey", "c_name"), ("s", "supplier", "s_suppkey", "s_name"), ("p", "part", "p_partkey", "p_name")]
    out = None
    for letter, table, key, name in parts:
        rows = _t(spark, sf, table).select(_tag(letter, key).alias("id"), F.col(name).alias("name"), F.lit(table).alias("type"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _edges(spark, sf) -> DataFrame:
    """Region, nation, customer by CONTAINS; supplier to part by CALLS, through line items; nation to region by IMPORTS."""
    nation, customer = _t(spark, sf, "nation"), _t(spark, sf, "customer")
    contains = nation.select(_tag("r", "n_regionkey").alias("from"), _tag("n", "n_nationkey").alias("to")).union(customer.select(_tag("n", "c_nationkey"), _tag("c", "c_custkey")))
    calls = _t(spark, sf, "lineitem").select(_tag("s", "l_suppkey").alias("from"), _tag("p", "l_partkey").alias("to"))
    imports = customer.select(_tag("c", "c_custkey").alias("from"), _tag("n", "c_nationkey").alias("to")).union(nation.select(_tag("n", "n_nationkey"), _tag("r", "n_regionkey")))
    return contains.withColumn("type", F.lit("CONTAINS")).union(calls.withColumn("type", F.lit("CALLS"))).union(imports.withColumn("type", F.lit("IMPORTS")))


def graph_find(spark, sf):
    return graph.find(_nodes(spark, sf), "AsIa").select("id", "type")


def graph_contains(spark, sf):
    return graph.contained(_nodes(spark, sf), _edges(spark, sf)).groupBy("from").agg(F.count(F.lit(1)).alias("n"))


def graph_callers(spark, sf):
    return graph.callers(_nodes(spark, sf), _edges(spark, sf)).groupBy("callee").agg(F.count(F.lit(1)).alias("callers"))


def graph_hotspots(spark, sf):
    return graph.hotspots(_edges(spark, sf))


def graph_complexity(spark, sf):
    return graph.complexity(_nodes(spark, sf), _edges(spark, sf), ["supplier", "part"])


def graph_stats(spark, sf):
    nodes = _nodes(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("node"))
    return nodes.unionByName(_edges(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("edge")))


def graph_impact(spark, sf):
    return graph.impact(_edges(spark, sf), "r1")


def graph_call_chain(spark, sf):
    """Paths down from regions that stop at the first customer of a kind."""
    steps = _edges(spark, sf).filter("type = 'CONTAINS'").select("from", "to")
    starts = _t(spark, sf, "region").select(_tag("r", "r_regionkey").alias("id"))
    found = graph.paths(starts, steps, 5, stop=F.col("end").endswith("7")).filter(F.col("end").endswith("7") & (F.col("n") > 0))
    return found.select(F.array_join("path", ">").alias("path"), "n")


def graph_traverse(spark, sf):
    steps = _edges(spark, sf).filter("type = 'CONTAINS'").select("from", "to")
    starts = _t(spark, sf, "region").select(_tag("r", "r_regionkey").alias("id"))
    return graph.traverse(starts, steps, 3).select(F.array_join("path", ">").alias("path"), "n")


def graph_traverse_reverse(spark, sf):
    steps = _edges(spark, sf).filter("type = 'CONTAINS'").select("from", "to")
    starts = _t(spark, sf, "customer").select(_tag("c", "c_custkey").alias("id"))
    return graph.traverse(starts, steps, 3, reverse=True).select(F.array_join("path", ">").alias("path"), "n")


def graph_connections(spark, sf):
    """From one supplier along all calls, back and forth."""
    calls = _edges(spark, sf).filter("type = 'CALLS'").select("from", "to").distinct()
    both = calls.union(calls.select("to", "from"))
    starts = _t(spark, sf, "supplier").filter("s_suppkey = 1").select(_tag("s", "s_suppkey").alias("id"))
    return graph.connections(starts, both, 4).groupBy("start", "n").agg(F.count(F.lit(1)).alias("reached"))


def _related(spark, sf) -> DataFrame:
    """Orders supported by customers that cite nations; strengths by amounts."""
    o = _t(spark, sf, "orders").select(_tag("o", "o_orderkey").alias("source"), F.when(F.col("o_orderkey") % 2 == 0, "supported_by").otherwise("contradicted_by").alias("relationship"), _tag("c", "o_custkey").alias("target"), F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 10) / 10).alias("strength"))
    return o.union(_t(spark, sf, "customer").select(_tag("c", "c_custkey"), F.lit("cites"), _tag("n", "c_nationkey"), (F.col("c_custkey") % 4 + 1) / 4))


def cross_query(spark, sf):
    nodes = _t(spark, sf, "orders").select(_tag("o", "o_orderkey").alias("id")).union(_t(spark, sf, "customer").filter("c_nationkey < 12").select(_tag("c", "c_custkey")))
    return graph.cross(nodes, _related(spark, sf)).select("source", "relationship", "target", F.round("strength", 6).alias("strength"))


def hypothesis_support(spark, sf):
    return graph.support(_related(spark, sf).filter("strength is not null")).select("hypothesis", "evidence", "code", F.round("confidence", 6).alias("confidence"))


def perspective_query(spark, sf):
    """Orders with a perspective of one clerk, by a nested key."""
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.create_map(F.lit("first"), F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")))).otherwise(F.create_map().cast("map<string,map<string,string>>")).alias("perspectives"))
    return o.filter(F.col("perspectives.first.status") == "O").select("id", F.col("perspectives.first.priority").alias("priority"))


def blocking_graph(spark, sf):
    """Blocked orders with the customer that blocks them, who may be unknown."""
    blocked = _t(spark, sf, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    blocker = _t(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("blocker"))
    return blocked.join(blocker, "o_custkey", "left").select("o_orderkey", "blocker")


def open_threads(spark, sf):
    """Customers as threads: their orders as hypotheses, open ones counted, with the mean strength of confidence."""
    orders = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("hypotheses"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    out = _t(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("hypotheses", F.lit(0)).alias("hypotheses"), F.coalesce("open", F.lit(0)).alias("open"))


def projection_boost(spark, sf):
    p = _t(spark, sf, "part")
    k = F.col("p_partkey")
    score = graph.boost(F.col("p_size"), k % 11, k % 7 == 0, k % 5 == 0, k % 13 == 0, (k % 10) / 10)
    return p.select("p_partkey", F.round(score, 6).alias("boost"))


QUERIES = {f.__name__: f for f in (graph_find, graph_contains, graph_callers, graph_hotspots, graph_complexity, graph_stats, graph_impact, graph_call_chain, graph_traverse, graph_traverse_reverse, graph_connections, cross_query, hypothesis_support, perspective_query, blocking_graph, open_threads, projection_boost)}

_N = "nodes AS (SELECT 'r' || r_regionkey AS id, r_name AS name, 'region' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 'c' || c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT 'p' || p_partkey, p_name, 'part' FROM part)"
_CONTAINS = "contains AS (SELECT 'r' || n_regionkey AS f, 'n' || n_nationkey AS t FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"
_CALLS = "calls AS (SELECT 's' || l_suppkey AS f, 'p' || l_partkey AS t FROM lineitem)"
_IMPORTS = "imports AS (SELECT 'c' || c_custkey AS f, 'n' || c_nationkey AS t FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"
_R = "related AS (SELECT 'o' || o_orderkey AS source, CASE WHEN o_orderkey % 2 = 0 THEN 'supported_by' ELSE 'contradicted_by' END AS relationship, 'c' || o_custkey AS target, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 10) / 10 END AS strength FROM orders UNION ALL SELECT 'c' || c_custkey, 'cites', 'n' || c_nationkey, (c_custkey % 4 + 1) / 4 FROM customer)"

ORACLE = {
    "graph_find": f"WITH {_N} SELECT id, type FROM nodes WHERE name = 'AsIa' OR contains(lower(name), 'asia') OR contains(lower(id), 'asia')",
    "graph_contains": f"WITH {_CONTAINS} SELECT f AS \"from\", count(*) AS n FROM contains GROUP BY 1",
    "graph_callers": f"WITH {_CALLS} SELECT t AS callee, count(DISTINCT f) AS callers FROM calls GROUP BY 1",
    "graph_hotspots": f"WITH {_CALLS} SELECT t AS callee, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, t)::INT AS rank FROM calls GROUP BY 1 ORDER BY rank LIMIT 20",
    "graph_complexity": f"WITH {_CALLS} SELECT f AS id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, f)::INT AS rank FROM calls GROUP BY 1 ORDER BY rank LIMIT 20",
    "graph_stats": f"WITH {_N}, {_CONTAINS}, {_CALLS}, {_IMPORTS} SELECT type, count(*) AS n, 'node' AS kind FROM nodes GROUP BY 1 UNION ALL SELECT 'CONTAINS', count(*), 'edge' FROM contains UNION ALL SELECT 'CALLS', count(*), 'edge' FROM calls UNION ALL SELECT 'IMPORTS', count(*), 'edge' FROM imports",
    "graph_impact": f"WITH {_IMPORTS}, one AS (SELECT DISTINCT f AS id FROM imports WHERE contains(t, 'r1')), two AS (SELECT DISTINCT f AS id FROM imports WHERE t IN (SELECT id FROM one) AND f NOT IN (SELECT id FROM one)) SELECT id, 1 AS hop FROM one UNION ALL SELECT id, 2 FROM two",
    "graph_call_chain": f"WITH RECURSIVE {_CONTAINS}, p AS (SELECT ['r' || r_regionkey] AS path, 'r' || r_regionkey AS e, 0 AS n FROM region UNION ALL SELECT list_append(path, t), t, n + 1 FROM p JOIN contains ON e = f WHERE n < 5 AND NOT ends_with(e, '7') AND NOT list_contains(path, t)) SELECT array_to_string(path, '>') AS path, n FROM p WHERE n > 0 AND ends_with(e, '7')",
    "graph_traverse": "SELECT 'r' || n_regionkey || '>n' || n_nationkey || '>c' || c_custkey AS path, 2 AS n FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT 'r' || n_regionkey || '>n' || n_nationkey, 1 FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)",
    "graph_traverse_reverse": "SELECT 'c' || c_custkey || '>n' || n_nationkey || '>r' || n_regionkey AS path, 2 AS n FROM nation JOIN customer ON c_nationkey = n_nationkey",
    "graph_connections": f"""WITH RECURSIVE {_CALLS}, c AS (SELECT DISTINCT f, t FROM calls), steps AS (SELECT f, t FROM c UNION SELECT t, f FROM c), w AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS e, 0 AS n FROM supplier WHERE s_suppkey = 1 UNION SELECT start, t, n + 1 FROM w JOIN steps ON e = f WHERE n < 3), m AS (SELECT start, e, min(n) AS n FROM w GROUP BY 1, 2)
SELECT start, n, count(*) AS reached FROM m WHERE n > 0 GROUP BY 1, 2""",
    "cross_query": f"WITH {_R}, nodes AS (SELECT 'o' || o_orderkey AS id FROM orders UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_nationkey < 12) SELECT source, relationship, target, round(coalesce(strength, 1), 6) AS strength FROM related WHERE coalesce(strength, 1) >= 0.5 AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)",
    "hypothesis_support": f"WITH {_R} SELECT a.source AS hypothesis, a.target AS evidence, b.target AS code, round(a.strength * b.strength, 6) AS confidence FROM related a JOIN related b ON a.target = b.source WHERE a.relationship IN ('supported_by', 'evidenced_by') AND b.relationship = 'cites' AND a.strength IS NOT NULL",
    "perspective_query": "SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderkey % 3 > 0 AND o_orderstatus = 'O'",
    "blocking_graph": "SELECT o_orderkey, c_name AS blocker FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) ON c_custkey = o_custkey WHERE o_orderstatus = 'P'",
    "open_threads": "SELECT c_custkey, count(o_orderkey) AS hypotheses, count(*) FILTER (o_orderstatus = 'O') AS open FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1",
    "projection_boost": "SELECT p_partkey, round((CASE WHEN p_size > 5 THEN 1.5 ELSE 1 END) * (CASE WHEN p_partkey % 11 > 5 THEN 1.8 ELSE 1 END) * (CASE WHEN p_partkey % 7 = 0 THEN 3 ELSE 1 END) * (CASE WHEN p_partkey % 5 = 0 THEN 2.5 ELSE 1 END) * (CASE WHEN p_partkey % 13 = 0 THEN 3 ELSE 1 END) * (CASE WHEN p_partkey % 10 > 3 AND p_partkey % 10 < 7 THEN 1.8 ELSE 1 END), 6)::DOUBLE AS boost FROM part",
}
