"""Queries of replicated state, the registry and the operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import crdt, log, registry


def _events(spark, sf) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("n", (F.col("event_id") % 97).cast("long"))


def lww_register(spark, sf):
    e = _events(spark, sf).withColumn("t", F.unix_micros("ts") / 1e6)
    return crdt.lww_register(e, "user_id", "value", "t", "event_type").select("user_id", F.round("value", 6).alias("value"), F.col("writer"))


def lww_map(spark, sf):
    e = _events(spark, sf).withColumn("t", F.unix_micros("ts") / 1e6).withColumn("v", F.when(F.col("event_id") % 4 > 0, F.col("value")))
    return crdt.lww_map(e, "user_id", "event_type", "v", "t", "event_type").select("user_id", "event_type", F.round("value", 6).alias("value"))


def orset_merge(spark, sf):
    e = _events(spark, sf)
    adds = e.filter("event_type <> 'error'").select("user_id", F.col("event_type").alias("element"), F.col("event_id").alias("tag"))
    dead = e.filter("event_id % 3 <> 0").select(F.col("event_id").alias("tag"))
    return crdt.orset_value(adds, dead, ["user_id"])


def vclock_merge(spark, sf):
    c = crdt.clocks(_events(spark, sf), "user_id", "event_type", "n")
    return c.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("clock")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("clock"))


def vclock_compare(spark, sf):
    c = crdt.clocks(_events(spark, sf), "user_id", "event_type", "n")
    after = c.select((F.col("user_id") - 1).alias("user_id"), F.col("clock").alias("after"))
    return c.join(after, "user_id").select("user_id", crdt.clock_compare(F.col("clock"), F.col("after")).alias("order"))


def truth_classify(spark, sf):
    """Orders as entries: an older and a newer clock of two agents, hashes by priority, status by order status."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_orderkey")
    old = F.create_map(F.lit("a"), k % 3, F.lit("b"), k % 2)
    new = F.create_map(F.lit("a"), k % 2, F.lit("b"), k % 5)
    status = F.when(F.col("o_orderstatus") == "F", "frozen").otherwise("active")
    old_hash, new_hash = F.when(k % 7 > 0, F.md5("o_orderpriority")), F.md5(F.when(k % 3 == 0, F.lit("x")).otherwise(F.col("o_orderpriority")))
    return o.select("o_orderkey", registry.classify(status, old_hash, new_hash, old, new).alias("result"))


def truth_stats(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") % 5 == 0).alias("pending"))


def truth_history(spark, sf):
    """Registrations of users by event types, folded in order."""
    e = _events(spark, sf)
    clock = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("view"), F.col("n") % 4, F.lit("click"), F.col("n") % 3))
    return registry.replay(e.select(F.col("user_id").alias("entry"), F.col("event_id").alias("seq"), F.col("event_type").alias("agent"), F.md5((F.col("event_id") % 5).cast("string")).alias("hash"), clock.alias("clock"), (F.col("event_id") % 301 == 0).alias("freeze")))


def roundtable_timeouts(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "ADR").otherwise("skill").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return registry.timed_out(registry.request(o), F.lit("1996-06-01").cast("timestamp")).select("id", "priority", "status")


def roundtable_outcome(spark, sf):
    return registry.outcome(_events(spark, sf).withColumn("approve", F.col("value") > 50), "user_id", "approve")


def _log(spark, sf) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "update").otherwise("add")
    rows = _events(spark, sf).select(F.col("event_id").alias("id"), "ts", op.alias("operation"), F.col("user_id").alias("doc_id"), F.col("props").alias("payload"), (F.col("event_id") % 3 != 0).alias("applied"))
    return rows.withColumn("checksum", F.when(F.col("id") % 11 == 0, "bad").otherwise(log.checksum(F.col("operation"), F.col("doc_id").cast("string"), F.col("payload"))))


def wal_unapplied(spark, sf):
    return log.unapplied(_log(spark, sf)).select("id", "operation", "doc_id")


def wal_checksum(spark, sf):
    return log.verified(_log(spark, sf)).select("id", "checksum", "valid")


def wal_compact(spark, sf):
    return log.compact(_log(spark, sf), 1000).select("id", "applied")


def wal_stats(spark, sf):
    return log.statistics(_log(spark, sf)).select("operation", "n", "pending", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))


def wal_replay_state(spark, sf):
    snapshot = spark.range(0, 40).select(F.col("id").alias("doc_id"), F.lit("old").alias("payload"))
    return log.replay(snapshot, _log(spark, sf), 500)


def snapshot_prune(spark, sf):
    names = _events(spark, sf).select(F.date_format("ts", "yyyyMMddHHmmss").alias("name"), "event_id")
    return log.prune(names, 24)


def recovery_check(spark, sf):
    return log.consistent(spark.read.parquet(f"{sf}/embeddings.parquet"), spark.read.parquet(f"{sf}/documents.parquet"))


QUERIES = {f.__name__: f for f in (lww_register, lww_map, orset_merge, vclock_merge, vclock_compare, truth_classify, truth_stats, truth_history, roundtable_timeouts, roundtable_outcome, wal_unapplied, wal_checksum, wal_compact, wal_stats, wal_replay_state, snapshot_prune, recovery_check)}

_E = "e AS (SELECT *, event_id % 97 AS n FROM events)"
_C = f"{_E}, c AS (SELECT user_id, event_type, max(n) AS n FROM e GROUP BY 1, 2)"
_L = "l AS (SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'update' ELSE 'add' END AS operation, user_id AS doc_id, props AS payload, event_id % 3 <> 0 AS applied FROM events), s AS (SELECT *, CASE WHEN id % 11 = 0 THEN 'bad' ELSE substr(sha256(operation || ':' || doc_id || ':' || payload), 1, 16) END AS checksum FROM l)"

ORACLE = {
    "lww_register": "SELECT user_id, round(max_by(value, (epoch_us(ts), event_type)), 6) AS value, max_by(event_type, (epoch_us(ts), event_type)) AS writer FROM events GROUP BY 1",
    "lww_map": "SELECT user_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS n FROM events) WHERE n = 1 AND event_id % 4 > 0",
    "orset_merge": "SELECT DISTINCT user_id, event_type AS element FROM events WHERE event_type <> 'error' AND event_id % 3 = 0",
    "vclock_merge": f"WITH {_C} SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS clock FROM c GROUP BY 1",
    "vclock_compare": f"""WITH {_C}, t AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id FROM events), f AS (SELECT u.user_id, t.event_type, coalesce(n, 0) AS n FROM u CROSS JOIN t LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = t.event_type)
SELECT a.user_id, CASE WHEN bool_or(a.n < b.n) AND bool_or(a.n > b.n) THEN 'CONCURRENT' WHEN bool_or(a.n < b.n) THEN 'A_BEFORE_B' WHEN bool_or(a.n > b.n) THEN 'B_BEFORE_A' ELSE 'EQUAL' END AS "order" FROM f a JOIN f b ON b.user_id = a.user_id + 1 AND a.event_type = b.event_type GROUP BY 1""",
    "truth_classify": """WITH o AS (SELECT *, o_orderkey AS k FROM orders), x AS (SELECT *, k % 3 AS a1, k % 2 AS b1, k % 2 AS a2, k % 5 AS b2, CASE WHEN k % 7 > 0 THEN md5(o_orderpriority) END AS h1, md5(CASE WHEN k % 3 = 0 THEN 'x' ELSE o_orderpriority END) AS h2 FROM o),
y AS (SELECT *, (a1 < a2 OR b1 < b2) AS less, (a1 > a2 OR b1 > b2) AS more FROM x)
SELECT o_orderkey, CASE WHEN h1 IS NULL THEN 'new' WHEN o_orderstatus = 'F' THEN 'frozen' WHEN less AND more AND h1 = h2 THEN 'merged' WHEN less AND more THEN 'conflict' WHEN more THEN 'stale' ELSE 'accepted' END AS result FROM y""",
    "truth_stats": "SELECT o_orderstatus AS status, o_orderpriority AS kind, count(*) AS n, count(*) FILTER (o_orderkey % 5 = 0) AS pending FROM orders GROUP BY 1, 2",
    "roundtable_timeouts": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'medium' END AS priority, CASE WHEN o_orderstatus <> 'O' THEN 'done' WHEN o_orderdate + INTERVAL 30 MINUTE < TIMESTAMP '1996-06-01' THEN 'timeout' ELSE 'pending' END AS status FROM orders",
    "roundtable_outcome": "WITH t AS (SELECT user_id, count(*) FILTER (value > 50) AS approvals, count(*) FILTER (NOT value > 50) AS rejections FROM events GROUP BY 1) SELECT *, CASE WHEN approvals + rejections = 0 THEN 'NO_VOTE' WHEN approvals = 0 OR rejections = 0 THEN 'UNANIMOUS' WHEN approvals > rejections THEN 'MAJORITY_APPROVE' WHEN approvals < rejections THEN 'MAJORITY_REJECT' ELSE 'SPLIT' END AS outcome FROM t",
    "wal_unapplied": f"WITH {_L} SELECT id, operation, doc_id FROM s WHERE NOT applied",
    "wal_checksum": f"WITH {_L} SELECT id, checksum, checksum = substr(sha256(operation || ':' || doc_id || ':' || payload), 1, 16) AS valid FROM s",
    "wal_compact": f"WITH {_L} SELECT id, applied FROM s WHERE NOT applied OR id IN (SELECT id FROM s WHERE applied ORDER BY id DESC LIMIT 1000)",
    "wal_stats": f"WITH {_L} SELECT operation, count(*) AS n, count(*) FILTER (NOT applied) AS pending, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM s GROUP BY 1",
    "wal_replay_state": f"""WITH {_L}, v AS (SELECT * FROM s WHERE NOT applied AND id > 500 AND id % 11 <> 0), net AS (SELECT doc_id, max_by(operation, id) AS operation, max_by(payload, id) AS payload FROM v GROUP BY 1), snap AS (SELECT unnest(range(40)) AS doc_id, 'old' AS payload)
SELECT coalesce(snap.doc_id, net.doc_id) AS doc_id, CASE WHEN net.doc_id IS NOT NULL THEN net.payload ELSE snap.payload END AS payload FROM snap FULL JOIN net ON snap.doc_id = net.doc_id WHERE coalesce(operation, 'add') <> 'delete'""",
    "snapshot_prune": "SELECT strftime(ts, '%Y%m%d%H%M%S') AS name, event_id FROM events ORDER BY ts DESC LIMIT 24",
    "recovery_check": "SELECT (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents) AS chunks, abs((SELECT count(*) FROM embeddings) - (SELECT count(*) FROM documents)) <= 100 AS consistent",
}
