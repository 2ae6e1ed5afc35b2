"""Streams: file changes with debouncing, samples, positions, and results with a time to live."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import diff


def arrivals(spark: SparkSession, root: str, pattern: str = "*", per_batch: int = 1000) -> DataFrame:
    """(path, ts, op, text): a stream of the files that appear under a folder, each once. Files that are written anew under
    their names, or go, are found by `polled`."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    return files.select("path", F.col("modificationTime").alias("ts"), F.lit("created").alias("op"), F.decode("content", "utf-8").alias("text"))


def polled(before: DataFrame | None, now: DataFrame) -> DataFrame:
    """(path, op): created, modified or deleted between two scans (path, mtime, size)."""
    if before is None:
        return now.select("path", F.lit("created").alias("op"))
    mark = F.struct("mtime", "size")
    change = diff(before.select("path", mark.alias("mark")), now.select("path", mark.alias("mark")), "path", "mark")
    names = F.create_map(*[F.lit(x) for x in ("NEW", "created", "MODIFIED", "modified", "DELETED", "deleted")])
    return change.select("path", names[F.col("change")].alias("op"))


def debounced(events: DataFrame, seconds: int = 2, late: str = "10 seconds") -> DataFrame:
    """(path, start, end, op, n): a quiet period after the last event of a path closes its run; the last operation counts."""
    return (
        events.withWatermark("ts", late)
        .groupBy("path", F.session_window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.max_by("op", "ts").alias("op"), F.count(F.lit(1)).alias("n"))
        .select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "op", "n")
    )


def on_batch(changes: DataFrame, index: Callable[[DataFrame], None], delete: Callable[[DataFrame], None], checkpoint: str):
    """Starts a query that hands each batch's last change of every path to `index` or `delete`."""

    def batch(frame: DataFrame, _: int) -> None:
        last = frame.groupBy("path").agg(F.max_by("op", "ts").alias("op")).persist()
        index(last.filter("op <> 'deleted'"))
        delete(last.filter("op = 'deleted'"))
        last.unpersist()

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def positions(updates: DataFrame, dim: int, weight: float = 0.3) -> DataFrame:
    """(agent, ts, speed): the exponential mean of velocity, from the last position and velocity kept for each agent."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, where, v = state.get if state.exists else (None, None, [0.0] * dim)
        out = []
        rows = pd.concat(list(frames)).sort_values("ts")
        for ts, p in zip(rows["ts"], rows["position"]):
            p, now = [float(x) for x in p], ts.timestamp()
            if at is not None and now > at:
                v = [weight * (b - a) / (now - at) + (1 - weight) * c for a, b, c in zip(where, p, v)]
            at, where = now, p
            out.append((key[0], ts, sum(x * x for x in v) ** 0.5))
        state.update((at, where, v))
        yield pd.DataFrame(out, columns=["agent", "ts", "speed"])

    return updates.groupBy("agent").applyInPandasWithState(step, "agent long, ts timestamp, speed double", "at double, position array<double>, velocity array<double>", "append", GroupStateTimeout.NoTimeout)


def latency_windows(samples: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(operation, start, n, avg, p95) of tumbling windows."""
    w = F.window("ts", window)
    return samples.withWatermark("ts", late).groupBy("operation", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("avg"), F.percentile_approx("ms", 0.95).alias("p95")).select("operation", F.col("w.start").alias("start"), "n", "avg", "p95")


def cached(puts: DataFrame, now, seconds: int = 300, entries: int = 1000) -> DataFrame:
    """Results (key, ts, value) still in a cache: the last put of a key, younger than the time to live, and among the
    last so many by time of putting."""

    last = puts.groupBy("key").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
    kept = last.orderBy(F.desc("ts")).limit(entries)
    return kept.filter(F.unix_seconds(now) - F.unix_seconds("ts") < seconds)
