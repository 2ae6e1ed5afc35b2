"""Queries of telemetry, memories, conversations, agents' positions and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import activity, keyword, reasoning
from ..operators.vector import top_k
from ..sources.rules import excluded


def _events(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def latency_percentiles(spark, sf):
    last = activity.last_n(_events(spark, sf), "event_type", "event_id", 1000)
    return activity.percentiles(last, "event_type", "value")


def metrics_snapshot(spark, sf):
    return activity.snapshot(_events(spark, sf), F.col("event_type") == "error", 60.0)


def agent_stats(spark, sf):
    agents = _events(spark, sf).withColumn("who", F.when(F.col("user_id") % 7 > 0, F.concat(F.lit("agent"), F.col("user_id") % 5)))
    return activity.agent_statistics(agents, "who", "value")


def last_n_samples(spark, sf):
    return activity.last_n(_events(spark, sf), "event_type", "event_id", 100).select("event_id", "event_type")


def memory_votes(spark, sf):
    e = _events(spark, sf).withColumn("vote", F.when(F.col("event_type") == "click", "up").otherwise(F.col("event_type")))
    return activity.votes(e, "user_id", "vote", "ts").select("user_id", "upvotes", "downvotes", F.unix_micros("last_voted_at").alias("last_voted_at"))


def _memories(spark, sf) -> DataFrame:
    e = _events(spark, sf)
    kind = F.when(F.col("event_type") == "signup", "handoff").otherwise(F.col("event_type"))
    read = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    return e.select(F.col("event_id").alias("id"), kind.alias("type"), F.when(F.col("event_id") % 2 == 0, "working").otherwise("archival").alias("tier"), "ts", F.concat(F.lit("u"), F.col("user_id") % 5).alias("to"), read.alias("read"), F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("timestamp").alias("last_accessed"))


def memory_archive(spark, sf):
    return activity.archive(_memories(spark, sf), F.lit("2024-01-20").cast("timestamp")).select("id", "tier")


def memory_stats(spark, sf):
    return _memories(spark, sf).groupBy("type", "tier").agg(F.count(F.lit(1)).alias("n"))


def memory_query(spark, sf):
    """Memories of a type by cosine with a vector; memory i has vector i."""
    from ..functions.vectors import cosine

    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    q = vectors.filter("id = 1").first()["v"]
    query = F.array(*[F.lit(x) for x in q])
    found = _memories(spark, sf).filter("type = 'click' and tier = 'archival'").join(vectors, "id").select("id", F.round(cosine(F.col("v"), query), 6).alias("score")).filter("score >= 0.05")
    return top_k(found, 5, [F.desc("score"), F.col("id")])


def access_count(spark, sf):
    hits = _events(spark, sf).filter("event_type = 'view'").select(F.col("user_id").alias("id"), "ts")
    out = activity.count_access(_memories(spark, sf), hits)
    return out.select("id", "access_count", F.unix_micros("last_accessed").alias("last_accessed"))


def handoffs(spark, sf):
    return activity.handoffs(_memories(spark, sf), "u2").select("id")


def _talk(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet").withColumn("seq", F.col("conv_id") * 1000 + F.col("turn"))


def recent_search(spark, sf):
    return activity.search_recent(_talk(spark, sf), "role", "seq", "text", "THE").select("role", "seq")


def session_messages(spark, sf):
    return activity.last_n(_talk(spark, sf), "role", "seq", 100).filter("conv_id = 95").select("role", "turn", F.substring("text", 1, 100).alias("preview"))


def hot_buffer(spark, sf):
    return activity.last_n(_talk(spark, sf), "role", "seq", 100).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def recent_ingestions(spark, sf):
    """The ten conversations of a kind that ended last, with a preview of their last message."""
    last = _talk(spark, sf).groupBy("conv_id").agg(F.max("turn").alias("turns"), F.max_by("role", "turn").alias("role"), F.substring(F.max_by("text", "turn"), 1, 100).alias("preview"))
    return top_k(last.filter("role = 'assistant'"), 10, [F.desc("conv_id")]).select("conv_id", "turns", "preview", "rank")


def archive_session(spark, sf):
    """Sessions as one text each, in order of turns."""
    part = F.concat(F.lit("## "), "role", F.lit("\n"), "text")
    joined = F.concat_ws("\n\n", F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("x")))), lambda t: t["x"]))
    return _talk(spark, sf).groupBy("conv_id").agg(F.sha2(joined, 256).alias("sha256"), F.length(joined).alias("n"))


def debounce_sessions(spark, sf):
    return activity.sessions(_events(spark, sf), "user_id", "ts", 3600).select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def _positions(spark, sf) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    e = _events(spark, sf).withColumn("vec_id", F.col("event_id") % 500)
    return e.join(vectors, "vec_id").select((F.col("user_id") % 20).alias("agent"), F.col("event_id").alias("seq"), (F.unix_micros("ts") / 1e6).alias("seconds"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("v"), "ts")


def grid_velocity_ema(spark, sf):
    """Speeds after each step of every agent."""
    return activity.velocities(_positions(spark, sf), "agent", "seq", "seconds", "v", 4).select("agent", "seq", F.round(F.col("speed") * 1e6, 4).alias("speed"))


def _latest(spark, sf) -> DataFrame:
    return _positions(spark, sf).groupBy("agent").agg(F.max_by("v", "seq").alias("v"), F.max("seconds").alias("seconds"))


def grid_nearby(spark, sf):
    return activity.nearby(_latest(spark, sf), "agent", "v", 3, 0.9).select("agent", F.round("distance", 6).alias("distance"))


def grid_proximity(spark, sf):
    latest = _latest(spark, sf)
    after = latest.select((F.col("agent") - 1).alias("agent"), F.col("v").alias("w"))
    return latest.join(after, "agent").select("agent", activity.proximity(activity.distance(F.col("v"), F.col("w"))).alias("label"))


def grid_stats(spark, sf):
    now = F.unix_seconds(F.lit("2024-01-30 20:00:00").cast("timestamp"))
    return activity.grid_statistics(_latest(spark, sf), now - F.col("seconds"), F.get("v", F.lit(0)), 3600.0)


def grid_pca(spark, sf):
    return activity.project(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding")


def reason_vector(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    return reasoning.reason_vector(vectors, [float(x) for x in vectors.filter("vec_id = 0").first()["embedding"]])


def reason_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = keyword.build(docs, "doc_id", "text")
    texts = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("path"), "text")

    def search(question: str) -> DataFrame:
        asked = spark.createDataFrame([(0, question)], "query_id long, text string")
        return keyword.search(index, asked, 5).join(texts, "id")

    found, _ = reasoning.reason_text(search, "the tion heat there", 2)
    return found.select("path", "rank")


def ignore_filter(spark, sf):
    """Pages whose address no ignore pattern meets."""
    path = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    return spark.read.parquet(f"{sf}/pages.parquet").filter(~excluded(path, ["# comment", "", "!kept", "m.*", "*/fr/*", "th*.example.net/*", "de"])).select("page_id")


def orders_by_agent_day(spark, sf):
    """Appended rows by agent and day, as a partitioned sink would hold them."""
    return _events(spark, sf).groupBy((F.col("user_id") % 5).alias("agent"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("props")).alias("bytes"))


QUERIES = {f.__name__: f for f in (latency_percentiles, metrics_snapshot, agent_stats, last_n_samples, memory_votes, memory_archive, memory_stats, memory_query, access_count, handoffs, recent_search, session_messages, hot_buffer, recent_ingestions, archive_session, debounce_sessions, grid_velocity_ema, grid_nearby, grid_proximity, grid_stats, grid_pca, reason_vector, reason_text, ignore_filter, orders_by_agent_day)}

_M = "m AS (SELECT event_id AS id, CASE WHEN event_type = 'signup' THEN 'handoff' ELSE event_type END AS type, CASE WHEN event_id % 2 = 0 THEN 'working' ELSE 'archival' END AS tier, ts, 'u' || (user_id % 5) AS \"to\" FROM events)"
_T = "t AS (SELECT *, conv_id * 1000 + turn AS seq FROM conversations), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY seq DESC) AS n FROM t) WHERE n <= 100)"
_P = "p AS (SELECT user_id % 20 AS agent, event_id AS seq, epoch_us(ts) / 1e6 AS seconds, (embedding::DOUBLE[])[1:4] AS v FROM events JOIN embeddings ON vec_id = event_id % 500), l AS (SELECT agent, max_by(v, seq) AS v, max(seconds) AS seconds FROM p GROUP BY 1)"
_D = "1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"

ORACLE = {
    "latency_percentiles": """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 1000), s AS (SELECT event_type, list_sort(list(value)) AS x, avg(value) AS a, count(*) AS n FROM r GROUP BY 1)
SELECT event_type, n::INT AS n, round(x[n // 2 + 1], 2) AS p50, round(CASE WHEN n >= 20 THEN x[floor(n * 0.95)::INT + 1] ELSE x[n] END, 2) AS p95, round(CASE WHEN n >= 100 THEN x[floor(n * 0.99)::INT + 1] ELSE x[n] END, 2) AS p99, round(a, 2) AS avg, round(x[1], 2) AS min, round(x[n], 2) AS max FROM s""",
    "metrics_snapshot": "SELECT count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') * 100 / count(*), 3) AS error_rate, round(count(*) / 60, 2) AS per_minute FROM events",
    "agent_stats": "SELECT CASE WHEN user_id % 7 > 0 THEN 'agent' || (user_id % 5) ELSE 'anonymous' END AS agent, count(*) AS queries, round(sum(value), 2) AS total_ms, round(avg(value), 2) AS avg_ms FROM events GROUP BY 1",
    "last_n_samples": "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 100",
    "memory_votes": "SELECT user_id, count(*) FILTER (event_type = 'click') AS upvotes, count(*) FILTER (event_type <> 'click') AS downvotes, epoch_us(max(ts)) AS last_voted_at FROM events GROUP BY 1",
    "memory_archive": f"WITH {_M} SELECT id, CASE WHEN tier = 'working' AND ts < TIMESTAMP '2024-01-13' THEN 'archival' ELSE tier END AS tier FROM m",
    "memory_stats": f"WITH {_M} SELECT type, tier, count(*) AS n FROM m GROUP BY 1, 2",
    "memory_query": f"WITH {_M}, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1), s AS (SELECT id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) AS score FROM m JOIN embeddings ON vec_id = id, q WHERE type = 'click' AND tier = 'archival') SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM s WHERE score >= 0.05 ORDER BY rank LIMIT 5",
    "access_count": f"WITH {_M}, h AS (SELECT user_id AS id, count(*) AS n, max(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1) SELECT m.id, coalesce(n, 0) AS access_count, epoch_us(t) AS last_accessed FROM m LEFT JOIN h ON h.id = m.id",
    "handoffs": f"WITH {_M} SELECT id FROM m WHERE type = 'handoff' AND \"to\" = 'u2' AND id % 3 <> 0",
    "recent_search": f"WITH {_T} SELECT role, seq FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY seq DESC) AS k FROM b WHERE contains(lower(text), 'the')) WHERE k <= 10",
    "session_messages": f"WITH {_T} SELECT role, turn, substr(text, 1, 100) AS preview FROM b WHERE conv_id = 95",
    "hot_buffer": f"WITH {_T} SELECT role, count(*) AS n, min(seq) AS first, max(seq) AS last FROM b GROUP BY 1",
    "recent_ingestions": "WITH l AS (SELECT conv_id, max(turn) AS turns, max_by(role, turn) AS role, substr(max_by(text, turn), 1, 100) AS preview FROM conversations GROUP BY 1) SELECT conv_id, turns, preview, row_number() OVER (ORDER BY conv_id DESC)::INT AS rank FROM l WHERE role = 'assistant' ORDER BY rank LIMIT 10",
    "archive_session": "WITH s AS (SELECT conv_id, string_agg('## ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS x FROM conversations GROUP BY 1) SELECT conv_id, sha256(x) AS sha256, length(x)::INT AS n FROM s",
    "debounce_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS \"end\", count(*) AS n FROM s GROUP BY user_id, k",
    "grid_velocity_ema": f"""WITH {_P}, u AS (SELECT agent, seq, seconds, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM p), r AS (SELECT agent, seq, k, (x - lag(x) OVER w) / nullif(greatest(seconds - lag(seconds) OVER w, 0), 0) AS raw FROM u WINDOW w AS (PARTITION BY agent, k ORDER BY seq)),
g AS (SELECT agent, seq, coalesce(list_sum(list_transform(list_reverse(list(raw) FILTER (raw IS NOT NULL) OVER (PARTITION BY agent, k ORDER BY seq ROWS BETWEEN 150 PRECEDING AND CURRENT ROW)), lambda y, i: 0.3::DOUBLE * pow(0.7::DOUBLE, i - 1) * y)), 0) AS v FROM r)
SELECT agent, seq, round(sqrt(sum(v * v)) * 1e6, 4) AS speed FROM g GROUP BY 1, 2""",
    "grid_nearby": f"WITH {_P} SELECT a.agent, round({_D}, 6) AS distance FROM l a, l b WHERE b.agent = 3 AND a.agent <> 3 AND {_D} < 0.9",
    "grid_proximity": f"WITH {_P} SELECT a.agent, CASE WHEN {_D} < 0.2 THEN 'highly aligned - working on same topic' WHEN {_D} < 0.5 THEN 'similar focus - related work' WHEN {_D} < 1 THEN 'different focus - parallel tracks' ELSE 'divergent - unrelated or opposing' END AS label FROM l a JOIN l b ON b.agent = a.agent + 1",
    "grid_stats": f"WITH {_P}, n AS (SELECT epoch_us(TIMESTAMP '2024-01-30 20:00:00') / 1e6 AS now) SELECT count(*) AS total, count(*) FILTER (now - seconds < 3600) AS active, count(*) FILTER (now - seconds > 3600) AS stale, round(avg(v[1]), 6) AS mean_speed FROM l, n",
    "ignore_filter": r"WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS p FROM pages) SELECT page_id FROM p WHERE NOT (regexp_matches(p, '^m\..*$') OR regexp_matches(p, '^.*/fr/.*$') OR regexp_matches(p, '^th.*\.example\.net/.*$') OR regexp_matches(split_part(p, '/', -1), '^m\..*$') OR list_contains(string_split(p, '/'), 'de'))",
    "orders_by_agent_day": "SELECT user_id % 5 AS agent, ts::DATE AS day, count(*) AS n, sum(strlen(props))::BIGINT AS bytes FROM events GROUP BY 1, 2",
}
