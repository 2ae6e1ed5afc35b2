"""Further queries: persistence, ids, validation, code, caches, capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bloom_bits
from ..operators import activity, chunk, graph, registry
from ..sources.tables import categories
from ..streaming.changes import cached


def _t(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def node_ids(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", graph.node_id(F.col("c_name")).cast("string").alias("id"))


def bloom_bits_query(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.array_join(bloom_bits(F.col("text")), ",").alias("bits"))


def graph_validation(spark, sf):
    nodes = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    related = _t(spark, sf, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 2000).alias("target"))
    return graph.validation(nodes, related)


def result_cache(spark, sf):
    puts = _t(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return cached(puts, F.lit("2024-01-30 12:00:00").cast("timestamp"), 86400, 100).select("key", F.round("value", 6).alias("value"))


def roundtable_rounds(spark, sf):
    e = _t(spark, sf, "events").select((F.col("user_id") % 10).alias("topic"), (F.col("event_id") % 3).alias("round"), F.col("event_id").alias("seq"), F.col("event_type").alias("agent"), "props")
    out = activity.rounds(e, "topic", "round", "agent")
    return out.select("topic", "round", "n", F.array_join("participants", ",").alias("participants"))


def coherence(spark, sf):
    return activity.coherence(_t(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("v")), "v").select("agents", F.round("coherence", 9).alias("coherence"))


def memory_store(spark, sf):
    rows = _t(spark, sf, "conversations").select(F.col("text").alias("content"), F.lit("learning").alias("type"), "conv_id", "turn")
    out = activity.store_memory(rows, ["learning", "decision", "context", "handoff", "insight", "error"])
    return out.select("conv_id", "turn", "checksum", "version", "access_count")


def payload_fields(spark, sf):
    p = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.col("source").alias("path"), F.col("lang").alias("text"), (F.col("doc_id") / 7).alias("score")))).otherwise(F.to_json(F.struct(F.col("source").alias("file_path"), F.to_json(F.struct(F.col("lang").alias("text"))).alias("_node_content"))))
    return activity.payload_fields(_t(spark, sf, "documents").select("doc_id", p.alias("p")), "p").select("doc_id", "path", "text", "score")


def category_files(spark, sf):
    paths = _t(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("path"))
    return categories(paths, {"french": ["*/fr/*"], "english": ["*/en/*"], "mobile": ["m.*"]}, ["*/de/*"])


def freeze(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "proposed").when(F.col("o_orderstatus") == "F", "active").otherwise("superseded").alias("status"))
    return registry.freeze(o, o.filter("id % 3 = 0").select("id"))


def snapshot_stats(spark, sf):
    return _t(spark, sf, "events").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value") / 1024, 2).alias("total"), F.date_format(F.max("ts"), "yyyyMMddHHmmss").alias("newest"), F.date_format(F.min("ts"), "yyyyMMddHHmmss").alias("oldest"))


def cache_size(spark, sf):
    return _t(spark, sf, "embeddings").agg(F.round(F.sum(F.size("embedding") * 4) / 1048576, 2).alias("mb"))


_SOURCE = "import os\nfrom a.b import c\n\nclass Part{0}(Base):\n    def run(self):\n        helper{0}(os.getpid())\n\ndef helper{0}(x):\n    return x\n"


def _code(spark, sf) -> DataFrame:
    """A small module for each supplier."""
    text = F.lit(_SOURCE)
    return _t(spark, sf, "supplier").select(F.concat(F.lit("m"), "s_suppkey", F.lit(".py")).alias("path"), F.replace(text, F.lit("{0}"), F.col("s_suppkey").cast("string")).alias("text"))


def chunk_python(spark, sf):
    return chunk.by_extension(_code(spark, sf), "path", "text").groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"), F.min("start_line").alias("first"), F.max("end_line").alias("last"))


def chunk_powershell(spark, sf):
    text = F.concat(F.lit("# x\nfunction Get-"), "s_suppkey", F.lit(" {\n  if ($a) {\n  }\n}\n"))
    return chunk.by_extension(_t(spark, sf, "supplier").select(F.concat("s_suppkey", F.lit(".ps1")).alias("path"), text.alias("text")), "path", "text").groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"), F.min("start_line").alias("first"), F.max("end_line").alias("last"))


def code_nodes_edges(spark, sf):
    return chunk.code_graph(_code(spark, sf), "path", "text").groupBy("kind", "type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__.removesuffix("_query"): f for f in (node_ids, bloom_bits_query, graph_validation, result_cache, roundtable_rounds, coherence, memory_store, payload_fields, category_files, freeze, snapshot_stats, cache_size, chunk_python, chunk_powershell, code_nodes_edges)}

ORACLE = {
    "node_ids": "SELECT c_custkey, ('0x' || substr(sha256(c_name), 1, 16))::UBIGINT::VARCHAR AS id FROM customer",
    "bloom_bits": "SELECT doc_id, (('0x' || right(md5(text), 8))::BIGINT % 8192) || ',' || (('0x' || right(sha1(text), 8))::BIGINT % 8192) AS bits FROM documents",
    "graph_validation": "WITH k AS (SELECT DISTINCT c_custkey AS id FROM customer), r AS (SELECT o_custkey AS source, o_orderkey % 2000 AS target FROM orders), i AS (SELECT * FROM r WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)) SELECT (SELECT count(*) FROM k) AS nodes, (SELECT count(*) FROM r) AS relations, (SELECT count(*) FROM i) AS \"inner\", (SELECT count(*) FROM k WHERE id NOT IN (SELECT source FROM i UNION SELECT target FROM i)) AS alone",
    "result_cache": "WITH l AS (SELECT user_id AS key, max_by(value, ts) AS value, max(ts) AS ts FROM events GROUP BY 1) SELECT key, round(value, 6) AS value FROM (SELECT * FROM l ORDER BY ts DESC LIMIT 100) WHERE epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(ts)) < 86400",
    "roundtable_rounds": "WITH f AS (SELECT user_id % 10 AS topic, event_id % 3 AS round, upper(event_type) AS a, min(event_id) AS s, count(*) AS n FROM events GROUP BY 1, 2, 3) SELECT topic, round, sum(n)::INT AS n, string_agg(a, ',' ORDER BY s) AS participants FROM f GROUP BY 1, 2",
    "coherence": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT unnest(v) / sqrt(list_dot_product(v, v)) AS x, generate_subscripts(v, 1) AS k FROM e), s AS (SELECT sum(x) AS s FROM u GROUP BY k), n AS (SELECT count(*) AS n FROM e) SELECT n AS agents, round((sum(s * s) - n) / (n * (n - 1)), 9) AS coherence FROM s, n GROUP BY n",
    "memory_store": "SELECT conv_id, turn, sha256(text) AS checksum, 1 AS version, 0::BIGINT AS access_count FROM conversations",
    "payload_fields": "SELECT doc_id, source AS path, lang AS text, CASE WHEN doc_id % 3 = 0 THEN round(doc_id / 7, 4) END AS score FROM documents",
    "category_files": r"WITH p AS (SELECT regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages), k AS (SELECT * FROM p WHERE NOT contains(path, '/de/')) SELECT DISTINCT 'french' AS category, path FROM k WHERE contains(path, '/fr/') UNION SELECT 'english', path FROM k WHERE contains(path, '/en/') UNION SELECT 'mobile', path FROM k WHERE starts_with(path, 'm.') OR starts_with(split_part(path, '/', -1), 'm.')",
    "freeze": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus IN ('O', 'F') THEN 'frozen' WHEN o_orderstatus = 'O' THEN 'proposed' WHEN o_orderstatus = 'F' THEN 'active' ELSE 'superseded' END AS status FROM orders",
    "snapshot_stats": "SELECT count(*) AS n, round(sum(value) / 1024, 2) AS total, strftime(max(ts), '%Y%m%d%H%M%S') AS newest, strftime(min(ts), '%Y%m%d%H%M%S') AS oldest FROM events",
    "cache_size": "SELECT round(sum(len(embedding) * 4) / 1048576, 2) AS mb FROM embeddings",
    "chunk_python": "SELECT k AS chunk_type, (SELECT count(*) FROM supplier) AS n, a::INT AS first, b::INT AS last FROM (VALUES ('module', 1, 3), ('class', 4, 4), ('method', 5, 7), ('function', 8, 10)) v(k, a, b)",
    "chunk_powershell": "SELECT 'function' AS chunk_type, count(*) AS n, 2 AS first, 5 AS last FROM supplier",
    "code_nodes_edges": "SELECT k AS kind, t AS type, (SELECT count(*) FROM supplier) * m AS n FROM (VALUES ('node', 'file', 1), ('node', 'class', 1), ('node', 'method', 1), ('node', 'function', 1), ('edge', 'CONTAINS', 3), ('edge', 'EXTENDS', 1), ('edge', 'IMPORTS', 2), ('edge', 'CALLS', 2)) v(k, t, m)",
}
