"""An operation log: checksums, replay, compaction; snapshots and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checksum(operation: Column, doc: Column, payload: Column) -> Column:
    """16 hex digits of SHA-256 over operation, document and payload (JSON with sorted keys)."""
    return F.substring(F.sha2(F.concat_ws(":", operation, doc, payload), 256), 1, 16)


def unapplied(log: DataFrame) -> DataFrame:
    return log.filter(~F.col("applied"))


def verified(log: DataFrame) -> DataFrame:
    return log.withColumn("valid", F.col("checksum") == checksum(F.col("operation"), F.col("doc_id").cast("string"), F.col("payload")))


def mark_applied(log: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    hit = log.join(ids.select("id", F.lit(True).alias("__a")), "id", "left")
    now = F.coalesce("__a", F.lit(False)) & ~F.col("applied")
    return hit.withColumn("applied_at", F.when(now, at).otherwise(F.col("applied_at"))).withColumn("applied", F.col("applied") | now).drop("__a")


def compact(log: DataFrame, keep: int) -> DataFrame:
    """All entries not applied, and the last `keep` applied ones: those at or above the id of the keep-th from the end."""
    last = log.filter("applied").select("id").orderBy(F.desc("id")).limit(keep).agg(F.min("id").alias("__least"))
    return log.crossJoin(F.broadcast(last)).filter(~F.col("applied") | (F.col("id") >= F.col("__least"))).drop("__least")


def statistics(log: DataFrame) -> DataFrame:
    """(operation, n, pending, first, last)."""
    return log.groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("applied")).alias("pending"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def replay(snapshot: DataFrame, log: DataFrame, position: int) -> DataFrame:
    """(doc_id, payload): the snapshot after valid, unapplied entries beyond its position; the last one of a document wins."""
    live = verified(unapplied(log).filter(F.col("id") > position)).filter("valid")
    net = live.groupBy("doc_id").agg(F.max_by(F.struct("operation", "payload"), "id").alias("net"))
    both = snapshot.select("doc_id", "payload", F.lit(True).alias("__s")).join(net, "doc_id", "full")
    return both.filter(F.coalesce(F.col("net.operation"), F.lit("add")) != "delete").select("doc_id", F.when(F.col("net").isNotNull(), F.col("net.payload")).otherwise(F.col("payload")).alias("payload"))


def prune(snapshots: DataFrame, keep: int = 24) -> DataFrame:
    """Snapshots (name, ...) beyond the newest `keep` leave; there are few, so one task ranks them."""
    return snapshots.withColumn("__n", F.row_number().over(W.orderBy(F.desc("name")))).filter(F.col("__n") <= keep).drop("__n")


def consistent(vectors: DataFrame, chunks: DataFrame, slack: int = 100) -> DataFrame:
    """One row: both counts, and whether they differ by no more than the slack."""
    a, b = vectors.agg(F.count(F.lit(1)).alias("vectors")), chunks.agg(F.count(F.lit(1)).alias("chunks"))
    return a.crossJoin(F.broadcast(b)).withColumn("consistent", F.abs(F.col("vectors") - F.col("chunks")) <= slack)


def write_snapshot(state: DataFrame, root: str, name: str, position: int) -> None:
    """A folder of Parquet with a manifest of its count, position and content hash; the manifest is written last."""
    path = f"{root}/{name}"
    state.write.parquet(f"{path}/state")
    back = state.sparkSession.read.parquet(f"{path}/state")
    _manifest(back, name, position).write.json(f"{path}/manifest")


def _manifest(state: DataFrame, name: str, position: int) -> DataFrame:
    columns = sorted(state.columns)
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    return state.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.lit(position).alias("position"), F.coalesce(total, F.lit(0)).cast("string").alias("content"))


def latest_valid(spark: SparkSession, root: str) -> tuple[DataFrame, int] | None:
    """The newest snapshot whose content matches its manifest, and its log position."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root).select(F.regexp_extract("path", r"/([^/]+)/manifest/", 1).alias("name")).distinct()
    for (name,) in names.orderBy(F.desc("name")).collect():
        state, manifest = spark.read.parquet(f"{root}/{name}/state"), spark.read.json(f"{root}/{name}/manifest").first()
        if _manifest(state, name, manifest["position"]).first()["content"] == manifest["content"]:
            return state, manifest["position"]
    return None
