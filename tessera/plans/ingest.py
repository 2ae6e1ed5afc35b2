"""Queries of ingestion, versions, caches and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, language
from ..operators import chunk, ingest


def _docs(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _hashed(spark, sf) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id") % 400).alias("path"), content_hash(F.col("text"), 16).alias("hash"), "n_chars", "lang", "source")


def hashes(spark, sf):
    return _docs(spark, sf).select("doc_id", content_hash(F.col("text")).alias("sha256"), content_hash(F.col("text"), 16).alias("hash"), F.md5("text").alias("md5"))


def dedup_by_hash(spark, sf):
    rows = _hashed(spark, sf).select("path", "hash", F.col("doc_id").alias("idx"), "doc_id")
    return ingest.dedup(rows, by_path=False).select("doc_id", "idx", "hash")


def dedup_by_path(spark, sf):
    rows = _hashed(spark, sf).select("path", "hash", F.col("doc_id").alias("idx"), "doc_id")
    return ingest.dedup(rows, by_path=True).select("doc_id", "idx", "path")


def dedup_report(spark, sf):
    h = _hashed(spark, sf)
    return h.agg(F.count(F.lit(1)).alias("before"), F.count_distinct("hash").alias("after"), (F.count(F.lit(1)) - F.count_distinct("hash")).alias("removed"))


def batch_add(spark, sf):
    h = _hashed(spark, sf).select(F.col("doc_id").alias("id"), "hash")
    return ingest.batch_add(h.filter("id % 3 = 0"), h.filter("id % 3 <> 0"), h.filter("id % 5 = 0"))


def _halves(spark, sf):
    h = ingest.first_per(_hashed(spark, sf), "path", F.asc("doc_id"))
    old = h.filter("doc_id % 4 <> 0").select("path", "hash", F.lit(1).alias("version"), F.col("n_chars").alias("size"), (F.col("doc_id") % 7 == 0).alias("deleted"))
    new = h.filter("doc_id % 4 <> 1").select("path", F.when(F.col("doc_id") % 3 == 0, F.reverse("hash")).otherwise(F.col("hash")).alias("hash"), F.col("n_chars").alias("size"))
    return old, new


def change_detect(spark, sf):
    old, new = _halves(spark, sf)
    return ingest.diff(old, new, "path", "hash")


def content_changed(spark, sf):
    old, new = _halves(spark, sf)
    return ingest.changed(old, new)


def unchanged_skip(spark, sf):
    h = _hashed(spark, sf).select("path", F.col("doc_id").alias("mtime"), F.col("n_chars").alias("size"))
    return ingest.unchanged(h.filter("mtime % 2 = 0"), h)


def doc_upsert_version(spark, sf):
    old, new = _halves(spark, sf)
    return ingest.upsert(old, new)


def incremental_update(spark, sf):
    h = _hashed(spark, sf)
    index = h.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "path", "hash", (F.col("doc_id") % 9 == 0).alias("deleted"))
    return ingest.incremental_update(index, h.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("seq"), "path", "hash"))


def compact_renumber(spark, sf):
    h = _hashed(spark, sf).select(F.col("doc_id").alias("id"), "path", "hash", (F.col("doc_id") % 3 == 0).alias("deleted"))
    return ingest.compact(h).select("id", "path", "hash")


def store_stats(spark, sf):
    h = _hashed(spark, sf).select(F.col("n_chars").alias("size"), (F.col("doc_id") % 5 == 0).alias("deleted"))
    return ingest.store_statistics(h, chunk.fixed(_docs(spark, sf), "source", "text"))


def store_languages(spark, sf):
    return _docs(spark, sf).filter("doc_id % 5 <> 0").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def index_stats(spark, sf):
    h = _hashed(spark, sf).withColumn("deleted", F.col("doc_id") % 3 == 0)
    return h.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("deleted")).alias("active"), F.count_if("deleted").alias("deleted"), F.count_distinct("path").alias("paths"))


def embed_cache_join(spark, sf):
    cache = spark.read.parquet(f"{sf}/embeddings.parquet").join(_hashed(spark, sf), F.col("vec_id") == F.col("doc_id")).select("hash", F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("model"), "embedding", "vec_id")
    cache = ingest.first_per(cache, ["hash", "model"], F.asc("vec_id"))
    found = ingest.cached_embeddings(_hashed(spark, sf), cache, "a")
    return found.select("doc_id", F.col("embedding").isNotNull().alias("hit"), F.round(F.get("embedding", 0), 6).alias("first"))


def _cache(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("last_used"), "props")


def cache_prune(spark, sf):
    return ingest.prune(_cache(spark, sf), F.lit("2024-01-20").cast("timestamp"), 7).select("event_id")


def cache_stats(spark, sf):
    hit = (F.col("event_id") % 3 > 0).cast("int")
    return _cache(spark, sf).agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("props")).alias("bytes"), F.round(F.sum(hit) * 100 / F.count(F.lit(1)), 1).alias("hit_rate"))


def language_map(spark, sf):
    path = F.concat(F.lit("x."), F.element_at(F.array(*[F.lit(e) for e in ("py", "TS", "md", "sh", "exe", "yml")]), (F.col("page_id") % 6 + 1).cast("int")))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", language(path).alias("language"))


def chunk_fixed(spark, sf):
    out = chunk.fixed(_docs(spark, sf), "doc_id", "text")
    return out.select("path", "chunk", F.length("content").alias("n"), F.md5("content").alias("md5"))


def chunk_generic(spark, sf):
    out = chunk.by_extension(_docs(spark, sf).select(F.concat(F.col("doc_id"), F.lit(".txt")).alias("path"), "text"), "path", "text")
    return out.select("path", "chunk_type", "start_line", "end_line", F.length("content").alias("n"))


def chunk_markdown(spark, sf):
    """Conversations as Markdown: a header of a level for each role."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    level = F.when(F.col("role") == "system", "# ").when(F.col("role") == "user", "## ").otherwise("### ")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat(level, F.lit("turn "), F.col("turn"), F.lit("\n"), F.col("text")).alias("x")))), lambda t: t["x"])
    text = turns.groupBy("conv_id").agg(F.concat_ws("\n", lines).alias("text"))
    return chunk.markdown(text, "conv_id", "text").select("key", "name", "parent", "start_line", "end_line", F.length("content").alias("n"))


def metadata_enrich(spark, sf):
    """Chunks with the version of the document that they come from."""
    chunks = chunk.fixed(_docs(spark, sf), "doc_id", "text").select("path")
    versions = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("base"), (F.col("doc_id") % 3 + 1).alias("version"))
    return chunks.withColumn("base", F.substring_index("path", "#chunk", 1)).join(versions.filter("version < 3"), "base", "left").select("path", "version")


QUERIES = {f"ingest_{f.__name__}" if f.__name__ in ("hashes",) else f.__name__: f for f in (hashes, dedup_by_hash, dedup_by_path, dedup_report, batch_add, change_detect, content_changed, unchanged_skip, doc_upsert_version, incremental_update, compact_renumber, store_stats, store_languages, index_stats, embed_cache_join, cache_prune, cache_stats, language_map, chunk_fixed, chunk_generic, chunk_markdown, metadata_enrich)}

_H = "h AS (SELECT doc_id, source || '/' || (doc_id % 400) AS path, substr(sha256(text), 1, 16) AS hash, n_chars, lang, source FROM documents)"
_HALVES = f"{_H}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_id) AS n FROM h) WHERE n = 1), old AS (SELECT path, hash, 1 AS version, n_chars AS size, doc_id % 7 = 0 AS deleted FROM f WHERE doc_id % 4 <> 0), new AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN reverse(hash) ELSE hash END AS hash, n_chars AS size FROM f WHERE doc_id % 4 <> 1)"

ORACLE = {
    "ingest_hashes": "SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, 16) AS hash, md5(text) AS md5 FROM documents",
    "dedup_by_hash": f"WITH {_H} SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, hash FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS n FROM h) WHERE n = 1",
    "dedup_by_path": f"WITH {_H} SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_id DESC) AS n FROM h) WHERE n = 1",
    "dedup_report": f"WITH {_H} SELECT count(*) AS before, count(DISTINCT hash) AS after, count(*) - count(DISTINCT hash) AS removed FROM h",
    "batch_add": f"WITH {_H} SELECT min(doc_id) AS id, hash, hash IN (SELECT hash FROM h WHERE doc_id % 5 = 0) AS cached FROM h WHERE doc_id % 3 <> 0 AND hash NOT IN (SELECT hash FROM h WHERE doc_id % 3 = 0) GROUP BY hash",
    "change_detect": f"WITH {_HALVES} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'NEW' WHEN n.path IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS change FROM old o FULL JOIN new n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash",
    "content_changed": f"WITH {_HALVES} SELECT n.path, o.hash IS DISTINCT FROM n.hash AS is_changed, o.hash IS NOT NULL AS was_known FROM new n LEFT JOIN (SELECT * FROM old WHERE NOT deleted) o ON o.path = n.path",
    "unchanged_skip": f"WITH {_H} SELECT path, doc_id AS mtime, n_chars AS size FROM h WHERE doc_id % 2 <> 0",
    "doc_upsert_version": f"WITH {_HALVES} SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN o.hash ELSE n.hash END AS hash, CASE WHEN n.path IS NULL THEN o.version ELSE coalesce(o.version, 0) + 1 END AS version, CASE WHEN n.path IS NULL THEN o.size ELSE n.size END AS size, n.path IS NULL AND o.deleted AS deleted FROM old o FULL JOIN new n ON o.path = n.path",
    "incremental_update": f"""WITH {_H}, i AS (SELECT doc_id AS id, path, hash, doc_id % 9 = 0 AS deleted FROM h WHERE doc_id % 2 = 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS m FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_id DESC) AS n FROM h WHERE doc_id % 2 = 1) WHERE n = 1) WHERE m = 1 AND hash NOT IN (SELECT hash FROM i WHERE NOT deleted))
SELECT id, path, hash, deleted OR path IN (SELECT path FROM f) AS deleted FROM i UNION ALL SELECT row_number() OVER (ORDER BY doc_id) - 1 + (SELECT coalesce(max(id) + 1, 0) FROM i), path, hash, false FROM f""",
    "compact_renumber": f"WITH {_H} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, path, hash FROM h WHERE doc_id % 3 <> 0",
    "store_stats": "SELECT count(*) FILTER (doc_id % 5 <> 0) AS live, count(*) FILTER (doc_id % 5 = 0) AS deleted, coalesce(sum(n_chars) FILTER (doc_id % 5 <> 0), 0)::BIGINT AS bytes, sum(CASE WHEN length(text) > 2000 THEN ceil(length(text) / 1500) ELSE 1 END)::BIGINT AS chunks FROM documents",
    "store_languages": "SELECT lang, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1",
    "index_stats": f"WITH {_H} SELECT count(*) AS total, count(*) FILTER (doc_id % 3 <> 0) AS active, count(*) FILTER (doc_id % 3 = 0) AS deleted, count(DISTINCT path) AS paths FROM h",
    "embed_cache_join": f"WITH {_H}, c AS (SELECT hash, min_by(embedding, vec_id) AS embedding FROM embeddings JOIN h ON vec_id = doc_id WHERE vec_id % 2 = 0 GROUP BY 1) SELECT doc_id, embedding IS NOT NULL AS hit, round(embedding[1], 6) AS first FROM h LEFT JOIN c USING (hash)",
    "cache_prune": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-13'",
    "cache_stats": "SELECT count(*) AS entries, sum(strlen(props))::BIGINT AS bytes, round(count(*) FILTER (event_id % 3 > 0) * 100 / count(*), 1) AS hit_rate FROM events",
    "language_map": "SELECT page_id, ['python', 'typescript', 'markdown', 'shell', NULL, 'yaml'][page_id % 6 + 1] AS language FROM pages",
    "chunk_fixed": "WITH c AS (SELECT doc_id, text, unnest(range(CASE WHEN length(text) > 2000 THEN ceil(length(text) / 1500)::BIGINT ELSE 1 END)) AS chunk FROM documents), t AS (SELECT CASE WHEN length(text) > 2000 THEN doc_id || '#chunk' || chunk ELSE doc_id::VARCHAR END AS path, chunk::INT AS chunk, CASE WHEN length(text) > 2000 THEN substr(text, chunk * 1500 + 1, 1500) ELSE text END AS content FROM c) SELECT path, chunk, length(content)::INT AS n, md5(content) AS md5 FROM t",
    "chunk_markdown": r"""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS l, text, length(text) - length(replace(text, chr(10), '')) + 2 AS lines FROM conversations),
p AS (SELECT *, 1 + sum(lines) OVER (PARTITION BY conv_id ORDER BY turn) - lines AS first, (SELECT max(b.turn * 10 + b.l) FROM t b WHERE b.conv_id = t.conv_id AND b.turn < t.turn AND b.l < t.l) AS head FROM t)
SELECT conv_id AS key, 'turn ' || turn AS name, CASE WHEN head % 10 = l - 1 THEN 'turn ' || (head // 10) END AS parent, first::INT AS start_line, (first + lines - 1)::INT AS end_line, length(regexp_replace(repeat('#', l) || ' turn ' || turn || chr(10) || text, '^\s+|\s+$', '', 'g'))::INT AS n FROM p""",
    "metadata_enrich": "WITH c AS (SELECT doc_id, length(text) AS l, unnest(range(CASE WHEN length(text) > 2000 THEN ceil(length(text) / 1500)::BIGINT ELSE 1 END)) AS chunk FROM documents) SELECT CASE WHEN l > 2000 THEN doc_id || '#chunk' || chunk ELSE doc_id::VARCHAR END AS path, CASE WHEN doc_id % 3 + 1 < 3 THEN doc_id % 3 + 1 END AS version FROM c",
}
