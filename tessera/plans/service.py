"""Queries of the store end to end, of nodes and their vectors, and of the interface's requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..functions.vectors import cosine
from ..operators import activity, chunk, crdt, fusion, graph, ingest, keyword, log, store, vector
from . import sql
from .graph import _CALLS, _N, _R, _edges, _nodes, _related
from .search import _index, _queries
from .state import _L, _log


def _t(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _files(spark, sf) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("path"), "text")


def _state(spark, sf) -> store.State:
    """A third of all documents are known, some of them changed since, some deleted."""
    d = _files(spark, sf).filter("doc_id % 3 = 0")
    h = F.when(F.col("doc_id") % 9 == 0, content_hash(F.col("text"), 16)).otherwise("old")
    held = d.select("path", h.alias("hash"), F.lit(1).alias("version"), F.length("text").cast("long").alias("size"), (F.col("doc_id") % 12 == 0).alias("deleted"))
    chunks = d.select("path", F.lit(0).alias("chunk_index"), h.alias("hash"), F.length("text").cast("long").alias("size"))
    index = d.select(F.col("doc_id").alias("id"), "path", h.alias("hash"), (F.col("doc_id") % 12 == 0).alias("deleted"))
    return store.State(held, chunks, index, spark.createDataFrame([], "operation string, doc_id string, payload string, checksum string, applied boolean"))


def _summary(s: store.State) -> DataFrame:
    index = s.index.groupBy("path").agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("dead"))
    chunks = s.chunks.groupBy("path").agg(F.count(F.lit(1)).alias("chunks"))
    entries = s.log.groupBy(F.col("doc_id").alias("path")).agg(F.count(F.lit(1)).alias("logged"))
    out = s.store.select("path", "version", "hash", "deleted").join(index, "path", "left").join(chunks, "path", "left").join(entries, "path", "left")
    return out.fillna(0, ["live", "dead", "chunks", "logged"])


def index_files(spark, sf):
    """Every second document is indexed into a store that knows a third of all."""
    return _summary(store.index_files(_state(spark, sf), _files(spark, sf).filter("doc_id % 2 = 0").select("path", "text")))


def delete_files(spark, sf):
    return _summary(store.delete_files(_state(spark, sf), _files(spark, sf).filter("doc_id % 4 = 2").select("path")))


def index_ids(spark, sf):
    """New rows of the index are numbered without gaps after the known ones."""
    out = store.index_files(_state(spark, sf), _files(spark, sf).filter("doc_id % 2 = 0").select("path", "text")).index
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.max("id").alias("last"))


def remove_index(spark, sf):
    return store.remove(_state(spark, sf).index, _files(spark, sf).filter("doc_id % 5 = 0").select("path")).select("id", "deleted")


def purge_store(spark, sf):
    s = _state(spark, sf)
    kept, chunks = store.purge(s.store, s.chunks)
    return store.chunk_counts(kept, chunks).select("path", "chunk_count")


def chunk_registry(spark, sf):
    """All documents' chunks registered anew, counted for the live documents."""
    s = _state(spark, sf)
    new = chunk.fixed(_files(spark, sf), "path", "text").select(F.substring_index("path", "#chunk", 1).alias("path"), F.col("chunk").alias("chunk_index"), F.md5("content").alias("hash"), F.length("content").cast("long").alias("size"))
    return store.chunk_counts(s.store, store.register_chunks(s.chunks, new)).select("path", "chunk_count")


def doc_lookup(spark, sf):
    return store.lookup(_state(spark, sf).store, _files(spark, sf).filter("doc_id % 2 = 0")).select("path", "version")


def migrate_index(spark, sf):
    h = _t(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "source", content_hash(F.col("text"), 16).alias("hash"))
    return store.migrate(h.withColumnRenamed("source", "path")).select("id", "path", "hash")


def path_cache(spark, sf):
    docs = _files(spark, sf).select("doc_id", "path", content_hash(F.col("text"), 16).alias("hash"))
    cache = docs.join(_t(spark, sf, "embeddings"), F.col("vec_id") == F.col("doc_id")).select("path", F.when(F.col("doc_id") % 4 > 0, F.col("hash")).otherwise("old").alias("hash"), "embedding")
    return store.path_cache(docs, cache).select("doc_id", F.round(F.get("embedding", 0), 6).alias("first"))


def read_through(spark, sf):
    """Cached vectors, and a hook's for the misses: here the length of the text."""
    docs = _t(spark, sf, "documents").select("doc_id", "text", content_hash(F.col("text"), 16).alias("hash"))
    cache = docs.filter("doc_id % 2 = 0").dropDuplicates(["hash"]).select("hash", F.lit("m").alias("model"), F.array(F.lit(-1.0)).alias("embedding"))
    return ingest.read_through(docs, cache, "m", lambda t: F.array(F.length(t).cast("double"))).select("doc_id", F.get("embedding", 0).alias("x"))


def bloom_probe(spark, sf):
    """Names of parts against a filter of those sold by few suppliers' line items."""
    held = _t(spark, sf, "part").filter("p_partkey % 8 = 0")
    return store.Bloom(held, F.col("p_name")).probe(_t(spark, sf, "part"), F.col("p_name")).select("p_partkey", "maybe")


def recover_state(spark, sf):
    """A snapshot that agrees with the documents in number once the log is replayed on it."""
    snapshot = spark.range(0, 40).select(F.col("id").alias("doc_id"), F.lit("old").alias("payload"))
    users = _t(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.lit("x").alias("payload")).distinct()
    state, how = store.recover((snapshot, 500), _log(spark, sf), users, slack=1_000_000)
    return state.withColumn("how", F.lit(how))


def recover_rebuilt(spark, sf):
    """Without a snapshot the state comes from the documents."""
    docs = _t(spark, sf, "documents").select("doc_id", F.md5("text").alias("payload"))
    state, how = store.recover(None, _log(spark, sf), docs)
    return state.withColumn("how", F.lit(how))


def recovery_status(spark, sf):
    names = _t(spark, sf, "events").filter("event_type = 'signup'").select(F.date_format("ts", "yyyyMMddHHmmss").alias("name"))
    return store.status(_log(spark, sf), names)


def wal_mark_applied(spark, sf):
    done = _log(spark, sf).withColumn("applied_at", F.lit(None).cast("timestamp"))
    out = log.mark_applied(done, done.filter("id % 2 = 0").select("id"), F.lit("2024-02-01").cast("timestamp"))
    return out.select("id", "applied", F.col("applied_at").isNotNull().alias("now"))


def active_sessions(spark, sf):
    e = _t(spark, sf, "events").select((F.col("event_id") % 700).alias("id"), F.col("event_id").alias("seq"))
    return store.start_sessions(_t(spark, sf, "part").filter("p_size < 10").select(F.col("p_partkey").alias("id")), e)


def memory_verify(spark, sf):
    kept = activity.store_memory(_t(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("content"), F.lit("learning").alias("type")), ["learning"])
    spoilt = kept.withColumn("content", F.when(F.col("turn") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return store.verify_checksums(spoilt).select("conv_id", "turn", "valid")


def clock_increment(spark, sf):
    c = crdt.clocks(_t(spark, sf, "events"), "user_id", "event_type", "event_id")
    up = crdt.clock_increment(F.col("clock"), "view")
    return c.select("user_id", up["view"].alias("view"), F.size(up).alias("agents"))


def _hits(spark, sf, k: int) -> DataFrame:
    texts = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("path"))
    return keyword.search(_index(spark, sf), _queries(spark, sf), k).withColumn("score", F.round(F.col("score") / 100, 6)).join(texts, "id")


def query_rerank_fallback(spark, sf):
    """Every benchmark item: thirty candidates, reranked to ten by a stand-in for a model, and remote hits (labels) where
    the result is too short or too weak."""
    local = _hits(spark, sf, 30)
    remote = _t(spark, sf, "labels").filter("quality = 1").join(_t(spark, sf, "documents"), "doc_id").groupBy(F.concat(F.lit("cloud/"), "source").alias("path")).agg(F.min("doc_id").alias("pos"), F.round(F.max("n_chars") / 100000, 6).alias("score"))
    cloud = remote.crossJoin(F.broadcast(_queries(spark, sf).select("query_id")))
    model = 1.0 / (1.0 + F.length("text"))
    out = fusion.answer(local, cloud, 10, model, least_score=0.002)
    return out.select("query_id", "path", F.round("score", 9).alias("score"), "source", "rank")


def hybrid_serverless(spark, sf):
    """Keyword and vector lists fused without reranking; without a keyword list the vector list alone counts."""
    near = vector.top_k(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", 0).alias("score")), 10, [F.round("score", 6).desc(), F.col("id")])
    return fusion.ranked(fusion.reciprocal_rank([(near, 1.0)]), 5).select("id", F.round("score", 9).alias("score"), "rank")


def node_search(spark, sf):
    """Nodes of some labels, nearest to a vector: the filter on any of several values comes first."""
    vectors = _t(spark, sf, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in vectors.filter("vec_id = 3").first()["embedding"]])
    tags = vectors.withColumn("tags", F.array(F.concat(F.lit("l"), "label"), F.concat(F.lit("m"), F.col("vec_id") % 3)))
    return vector.knn_cosine(tags, q, 20, where=F.arrays_overlap("tags", F.array(F.lit("l2"), F.lit("m1")))).select("vec_id", F.round("score", 6).alias("score"), "rank")


def code_search(spark, sf):
    """Vectors of code nodes with their lines as text."""
    vectors = _t(spark, sf, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in vectors.filter("vec_id = 5").first()["embedding"]])
    near = vector.knn_cosine(vectors, q, 10, where=F.col("label") % 2 == 0)
    lines = vectors.select("vec_id", F.concat(F.col("label") + 1, F.lit("-"), F.col("label") + F.col("vec_id")).alias("lines"))
    return near.join(lines, "vec_id").select("vec_id", F.round("score", 6).alias("score"), "lines", "rank")


def node_query(spark, sf):
    found = graph.query(_nodes(spark, sf), {"type": "part"}, F.contains(F.lower("name"), F.lit("green")) | F.contains(F.col("id"), F.lit("7")), 100, ["id"])
    return found.select("id", "type")


def node_upsert(spark, sf):
    """Customers' names from orders' clerks replace known nodes; unknown ones are added."""
    nodes = _t(spark, sf, "customer").filter("c_custkey % 2 = 0").select(graph.node_id(F.concat(F.lit("c"), "c_custkey")).cast("string").alias("id"), F.col("c_name").alias("name"))
    new = _t(spark, sf, "customer").filter("c_custkey % 3 = 0").select(graph.node_id(F.concat(F.lit("c"), "c_custkey")).cast("string").alias("id"), F.upper("c_mktsegment").alias("name"))
    return graph.upsert(nodes, new)


def investigation_impact(spark, sf):
    """Threads (customers) whose open hypotheses (orders) name files (line items' parts)."""
    files = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("files"))
    hypotheses = _t(spark, sf, "orders").filter("o_orderstatus = 'O'").join(files, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("thread"), F.col("o_orderkey").alias("hypothesis"), "files")
    return graph.investigation_impact(hypotheses)


def api_graph_query(spark, sf):
    nodes = _t(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.create_map(F.lit("technical"), F.create_map(F.lit("status"), F.col("o_orderstatus")))).alias("perspectives"))
    return graph.by_perspective(nodes, "technical", 500)


def cross_references(spark, sf):
    return graph.cross_count(_related(spark, sf), "o", "c")


def prepared_export(spark, sf):
    return graph.neighbour_arrays(_edges(spark, sf).filter("type = 'CALLS'"), 50).select("id", F.size("calls").alias("calls"), F.size("called_by").alias("called_by"), F.get("calls", 0).alias("first"))


def code_embed_text(spark, sf):
    nodes = _t(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("function").alias("type"), F.col("s_name").alias("name"), F.lit("body").alias("code"))
    return graph.embed_text(nodes, _edges(spark, sf)).select("id", F.md5("embed_text").alias("md5"))


def chunk_embed_text(spark, sf):
    rows = _t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("path"), F.col("p_type").alias("chunk_type"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit("x").alias("content"))
    return chunk.embed_text(rows).select("p_partkey", F.length("embed_text").alias("n"))


def thoughts(spark, sf):
    """Similarity and magnitude of successive vectors."""
    v = _t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return v.join(after, "vec_id").select("vec_id", F.round(cosine(F.col("v"), F.col("w")), 6).alias("similarity"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("magnitude"))


QUERIES = {f.__name__: f for f in (index_files, delete_files, index_ids, remove_index, purge_store, chunk_registry, doc_lookup, migrate_index, path_cache, read_through, bloom_probe, recover_state, recover_rebuilt, recovery_status, wal_mark_applied, active_sessions, memory_verify, clock_increment, query_rerank_fallback, hybrid_serverless, node_search, code_search, node_query, node_upsert, investigation_impact, api_graph_query, cross_references, prepared_export, code_embed_text, chunk_embed_text, thoughts)}

_SLICES = "CASE WHEN length(text) > 2000 THEN ceil(length(text) / 1500)::BIGINT ELSE 1 END"
_S = f"""d AS (SELECT doc_id, 'd' || doc_id || '.txt' AS path, substr(sha256(text), 1, 16) AS h, {_SLICES} AS slices FROM documents),
s AS (SELECT doc_id, path, h, CASE WHEN doc_id % 9 = 0 THEN h ELSE 'old' END AS hash, doc_id % 12 = 0 AS deleted FROM d WHERE doc_id % 3 = 0),
f AS (SELECT d.* FROM d LEFT JOIN s USING (doc_id) WHERE d.doc_id % 2 = 0 AND NOT coalesce(NOT s.deleted AND s.hash = d.h, false))"""
_BLOOM = "(SELECT p_partkey, p_name, ('0x' || right(md5(p_name), 8))::BIGINT % 8192 AS a, ('0x' || right(sha1(p_name), 8))::BIGINT % 8192 AS b FROM part)"
_APPLIED = "(SELECT doc_id, max_by(operation, id) AS operation, max_by(payload, id) AS payload FROM s WHERE NOT applied AND checksum <> 'bad' AND id > 500 GROUP BY 1)"

ORACLE = {
    "index_files": f"""WITH {_S} SELECT coalesce(s.path, f.path) AS path, (CASE WHEN f.path IS NULL THEN 1 WHEN s.path IS NULL THEN 1 ELSE 2 END)::INT AS version, coalesce(f.h, s.hash) AS hash, CASE WHEN f.path IS NULL THEN s.deleted ELSE false END AS deleted,
coalesce(f.slices, 0) + (CASE WHEN f.path IS NULL AND NOT s.deleted THEN 1 ELSE 0 END) AS live, (CASE WHEN s.path IS NOT NULL AND (f.path IS NOT NULL OR s.deleted) THEN 1 ELSE 0 END)::BIGINT AS dead, coalesce(f.slices, 1) AS chunks, (f.path IS NOT NULL)::BIGINT AS logged FROM s FULL JOIN f ON s.path = f.path""",
    "delete_files": f"WITH {_S} SELECT path, 1::INT AS version, hash, deleted OR doc_id % 4 = 2 AS deleted, (NOT deleted AND doc_id % 4 <> 2)::BIGINT AS live, (deleted OR doc_id % 4 = 2)::BIGINT AS dead, 1::BIGINT AS chunks, (NOT deleted AND doc_id % 4 = 2)::BIGINT AS logged FROM s",
    "index_ids": f"WITH {_S} SELECT (SELECT count(*) FROM s) + (SELECT sum(slices) FROM f)::BIGINT AS n, (SELECT count(*) FROM s) + (SELECT sum(slices) FROM f)::BIGINT AS ids, (SELECT max(doc_id) FROM s) + (SELECT sum(slices) FROM f)::BIGINT AS last",
    "remove_index": f"WITH {_S} SELECT doc_id AS id, deleted OR doc_id % 5 = 0 AS deleted FROM s",
    "purge_store": f"WITH {_S} SELECT path, 1::BIGINT AS chunk_count FROM s WHERE NOT deleted",
    "chunk_registry": f"WITH {_S} SELECT s.path, d.slices AS chunk_count FROM s JOIN d USING (doc_id) WHERE NOT deleted",
    "doc_lookup": f"WITH {_S} SELECT path, 1::INT AS version FROM s WHERE NOT deleted AND doc_id % 2 = 0",
    "migrate_index": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, source AS path, substr(sha256(text), 1, 16) AS hash FROM documents",
    "path_cache": "SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN round(embedding[1], 6) END AS first FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "read_through": "SELECT doc_id, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) THEN -1.0 ELSE length(text)::DOUBLE END AS x FROM documents",
    "bloom_probe": f"WITH b AS {_BLOOM}, held AS (SELECT a AS bit FROM b WHERE p_partkey % 8 = 0 UNION SELECT b FROM b WHERE p_partkey % 8 = 0) SELECT p_partkey, a IN (SELECT bit FROM held) AND b IN (SELECT bit FROM held) AS maybe FROM b",
    "recover_state": f"WITH {_L}, net AS {_APPLIED}, snap AS (SELECT range AS doc_id, 'old' AS payload FROM range(40)) SELECT coalesce(snap.doc_id, net.doc_id) AS doc_id, CASE WHEN net.doc_id IS NOT NULL THEN net.payload ELSE snap.payload END AS payload, 'snapshot' AS how FROM snap FULL JOIN net ON snap.doc_id = net.doc_id WHERE coalesce(operation, 'add') <> 'delete'",
    "recover_rebuilt": "SELECT doc_id, md5(text) AS payload, 'rebuilt' AS how FROM documents",
    "recovery_status": "SELECT count(*) AS entries, count(*) FILTER (event_id % 3 = 0) AS pending, count(*) FILTER (event_type = 'signup') AS snapshots, max(strftime(ts, '%Y%m%d%H%M%S')) FILTER (event_type = 'signup') AS newest FROM events",
    "wal_mark_applied": "SELECT event_id AS id, event_id % 3 <> 0 OR event_id % 2 = 0 AS applied, event_id % 3 = 0 AND event_id % 2 = 0 AS now FROM events",
    "active_sessions": "SELECT event_id % 700 AS id, event_id AS seq, CASE WHEN event_id % 700 IN (SELECT p_partkey FROM part WHERE p_size < 10) OR row_number() OVER (PARTITION BY event_id % 700 ORDER BY event_id) > 1 THEN 'duplicate id' END AS error FROM events",
    "memory_verify": "SELECT conv_id, turn, turn % 3 <> 0 AS valid FROM conversations",
    "clock_increment": "SELECT user_id, coalesce(max(event_id) FILTER (event_type = 'view'), 0) + 1 AS view, (count(DISTINCT event_type) + (count(*) FILTER (event_type = 'view') = 0)::INT)::INT AS agents FROM events GROUP BY 1",
    "query_rerank_fallback": f"""WITH {sql.bm25(30)}, l AS (SELECT query_id, id, rank, source AS path, text, count(*) OVER (PARTITION BY query_id) AS n, round(score / 100, 6) AS old FROM bm25 JOIN documents ON id = doc_id),
m AS (SELECT *, CASE WHEN n > 10 THEN 1 / (1.0::DOUBLE + length(text)) ELSE old END AS score FROM l), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 10 THEN score ELSE 0 END DESC, rank) AS r FROM m), k AS (SELECT * FROM t WHERE r <= 10),
weak AS (SELECT item_id AS query_id, count(k.id) < 3 OR coalesce(min_by(score, r), 0) < 0.002 AS weak FROM benchmark LEFT JOIN k ON item_id = query_id GROUP BY 1),
c AS (SELECT 'cloud/' || source AS path, min(doc_id) AS pos, round(max(n_chars) / 100000, 6) AS score FROM labels JOIN documents USING (doc_id) WHERE quality = 1 GROUP BY 1),
u AS (SELECT query_id, path, score, 0 AS list, r AS pos, 'local' AS source FROM k JOIN weak USING (query_id) WHERE weak UNION ALL SELECT query_id, path, score, 1, pos, 'cloud' FROM c, weak WHERE weak),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY list, pos) AS x FROM u) WHERE x = 1)
SELECT query_id, path, round(score, 9) AS score, 'local' AS source, r::INT AS rank FROM k JOIN weak USING (query_id) WHERE NOT weak
UNION ALL SELECT * FROM (SELECT query_id, path, round(score, 9) AS score, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list, pos)::INT AS rank FROM once) WHERE rank <= 10""",
    "hybrid_serverless": "SELECT id, round(1 / (60.0::DOUBLE + rank), 9) AS score, rank::INT AS rank FROM (SELECT vec_id AS id, row_number() OVER (ORDER BY round(embedding[1]::DOUBLE, 6) DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 5",
    "node_search": f"SELECT * FROM (SELECT e.vec_id, round({sql.COSINE}, 6) AS score, row_number() OVER (ORDER BY round({sql.COSINE}, 9) DESC, e.vec_id)::INT AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE label = 2 OR vec_id % 3 = 1) WHERE rank <= 20",
    "code_search": f"SELECT * FROM (SELECT e.vec_id, round({sql.COSINE}, 6) AS score, (label + 1) || '-' || (label + vec_id) AS lines, row_number() OVER (ORDER BY round({sql.COSINE}, 9) DESC, e.vec_id)::INT AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE label % 2 = 0) WHERE rank <= 10",
    "node_query": f"WITH {_N} SELECT id, type FROM nodes WHERE type = 'part' AND (contains(lower(name), 'green') OR contains(id, '7')) ORDER BY id LIMIT 100",
    "node_upsert": "WITH k AS (SELECT c_custkey, ('0x' || substr(sha256('c' || c_custkey), 1, 16))::UBIGINT::VARCHAR AS id, c_name, upper(c_mktsegment) AS segment FROM customer) SELECT id, CASE WHEN c_custkey % 3 = 0 THEN segment ELSE c_name END AS name FROM k WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "investigation_impact": "SELECT o_custkey AS thread, count(*) AS hypotheses, sum(files)::BIGINT AS files FROM orders JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS files FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY 1",
    "api_graph_query": "SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderkey % 3 > 0 ORDER BY id LIMIT 100",
    "cross_references": f"WITH {_R} SELECT relationship, count(*) AS n FROM related WHERE starts_with(source, 'o') AND starts_with(target, 'c') GROUP BY 1",
    "prepared_export": f"WITH {_CALLS}, e AS (SELECT DISTINCT f, t FROM calls), i AS (SELECT f AS id FROM e UNION SELECT t FROM e), a AS (SELECT f AS id, count(*) AS n, min(t) AS first FROM e GROUP BY 1), b AS (SELECT t AS id, count(*) AS n FROM e GROUP BY 1) SELECT id, least(50, coalesce(a.n, 0))::INT AS calls, least(50, coalesce(b.n, 0))::INT AS called_by, first FROM i LEFT JOIN a USING (id) LEFT JOIN b USING (id)",
    "code_embed_text": f"WITH {_CALLS}, c AS (SELECT f AS id, list_sort(list(DISTINCT t))[1:10] AS l FROM calls GROUP BY 1) SELECT 's' || s_suppkey AS id, md5('function ' || s_name || chr(10) || 'body' || coalesce(chr(10) || 'Calls: ' || array_to_string(l, ', '), '')) AS md5 FROM supplier LEFT JOIN c ON id = 's' || s_suppkey",
    "chunk_embed_text": "SELECT p_partkey, length('File: ' || p_brand || chr(10) || 'Type: ' || p_type || chr(10) || 'Name: ' || p_name || chr(10) || chr(10) || 'x')::INT AS n FROM part",
    "thoughts": f"SELECT q.vec_id, round({sql.COSINE}, 6) AS similarity, round(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS magnitude FROM embeddings q JOIN embeddings e ON e.vec_id = q.vec_id + 1",
}
