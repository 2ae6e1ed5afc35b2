"""Latencies, agents' positions, memories and conversations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_text
from ..functions.vectors import cosine, norm


def last_n(rows: DataFrame, key: str | list[str], order: str, n: int) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter(F.col("__n") <= n).drop("__n")


def percentiles(samples: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, p50, p95, p99, avg, min, max), rounded to 2 places: values at places n // 2, int(.95 n) from 20 samples on,
    int(.99 n) from 100 on, else the greatest. Windows of samples are bounded by last_n."""
    s = samples.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("x"), F.avg(value).alias("avg")).withColumn("n", F.size("x"))
    at = lambda i: F.get("x", i.cast("int"))
    last = F.get("x", F.col("n") - 1)
    r = lambda c, name: F.round(c, 2).alias(name)
    return s.select(key, "n", r(at(F.floor(F.col("n") / 2)), "p50"), r(F.when(F.col("n") >= 20, at(F.floor(F.col("n") * 0.95))).otherwise(last), "p95"), r(F.when(F.col("n") >= 100, at(F.floor(F.col("n") * 0.99))).otherwise(last), "p99"), r(F.col("avg"), "avg"), r(F.get("x", F.lit(0)), "min"), r(last, "max"))


def snapshot(requests: DataFrame, is_error: Column, minutes: float) -> DataFrame:
    """One row: requests, errors, error rate in percent (3 places), requests a minute (2 places)."""
    t = requests.agg(F.count(F.lit(1)).alias("requests"), F.count_if(is_error).alias("errors"))
    return t.select("requests", "errors", F.round(F.when(F.col("requests") > 0, F.col("errors") * 100 / F.col("requests")).otherwise(0.0), 3).alias("error_rate"), F.round(F.col("requests") / minutes, 2).alias("per_minute"))


def agent_statistics(queries: DataFrame, agent: str, ms: str) -> DataFrame:
    return queries.groupBy(F.coalesce(F.col(agent), F.lit("anonymous")).alias("agent")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.sum(ms), 2).alias("total_ms"), F.round(F.avg(ms), 2).alias("avg_ms"))


def votes(rows: DataFrame, key: str, vote: str, ts: str) -> DataFrame:
    """(key, upvotes, downvotes, last_voted_at): whatever is not `up` is down."""
    up = F.col(vote) == "up"
    return rows.groupBy(key).agg(F.count_if(up).alias("upvotes"), F.count_if(~F.coalesce(up, F.lit(False))).alias("downvotes"), F.max(ts).alias("last_voted_at"))


def archive(memories: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Working memories older than the given days become archival."""
    old = (F.col("tier") == "working") & (F.col("ts") < now - F.expr(f"INTERVAL {days} DAYS"))
    return memories.withColumn("tier", F.when(old, "archival").otherwise(F.col("tier")))


def count_access(memories: DataFrame, hits: DataFrame) -> DataFrame:
    """access_count and last_accessed after hits (id, ts)."""
    t = hits.groupBy("id").agg(F.count(F.lit(1)).alias("__n"), F.max("ts").alias("__t"))
    return memories.join(t, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("__n", F.lit(0))).withColumn("last_accessed", F.greatest("last_accessed", "__t")).drop("__n", "__t")


def handoffs(memories: DataFrame, to: str, unread: bool = True) -> DataFrame:
    """Handoffs to an agent; one that was never marked counts as unread."""
    own = memories.filter((F.col("type") == "handoff") & (F.col("to") == to))
    return own.filter(~F.coalesce("read", F.lit(False))) if unread else own


def search_recent(log: DataFrame, key: str, order: str, text: str, needle: str, buffer: int = 100, k: int = 10) -> DataFrame:
    """The newest k rows of each key whose text holds the needle, within its last rows."""
    return last_n(last_n(log, key, order, buffer).filter(contains_text(F.col(text), needle)), key, order, k)


def velocities(positions: DataFrame, agent: str, seq: str, seconds: str, vector: str, dim: int, weight: float = 0.3, rows: int = 10_000, lead: int = 256) -> DataFrame:
    """(agent, seq, velocity, speed): an exponential mean of the change of position a second, in order for each agent.

    A step without time keeps the velocity; the first is 0. A track is folded in stretches of `rows` steps, each led in
    by the `lead` steps before it: what lies further back weighs (1 - weight) ** lead, below a double's precision
    unless most of these steps take no time.
    """
    order = W.partitionBy(agent).orderBy(seq)
    dt, before = F.col(seconds) - F.lag(seconds).over(order), F.lag(vector).over(order)
    steps = positions.select(F.col(agent).alias("agent"), F.col(seq).alias("seq"), dt.alias("dt"), F.col(vector).alias("v"), before.alias("p"), (F.row_number().over(order) - 1).alias("n"))
    raw = F.when(F.col("dt") > 0, F.zip_with("v", "p", lambda a, b: (a - b) / F.col("dt")))
    part = F.floor(F.col("n") / rows)
    parts = F.when(F.col("n") % rows >= rows - lead, F.array(part, part + 1)).otherwise(F.array(part))
    each = steps.select("agent", "seq", raw.alias("raw"), part.alias("own"), F.explode(parts).alias("part"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        now, out = np.zeros(dim), []
        for x in frame["raw"]:
            if x is not None:
                now = weight * np.asarray(x, float) + (1 - weight) * now
            out.append(now)
        mine = (frame["own"] == frame["part"]).to_numpy()
        kept = [v.tolist() for v, m in zip(out, mine) if m]
        return pd.DataFrame({agent: frame["agent"][mine], seq: frame["seq"][mine], "velocity": pd.Series(kept, dtype=object, index=frame.index[mine]), "speed": np.array([np.sqrt(sum(x * x for x in v)) for v in kept], float)})

    kinds = dict(positions.dtypes)
    return each.groupBy("agent", "part").applyInPandas(fold, f"{agent} {kinds[agent]}, {seq} {kinds[seq]}, velocity array<double>, speed double")


def distance(a: Column, b: Column) -> Column:
    """1 - cosine; infinite where a norm is 0 or a side unknown."""
    return F.when((norm(a) > 0) & (norm(b) > 0), 1 - cosine(a, b)).otherwise(float("inf"))


def proximity(d: Column) -> Column:
    # What distances are called.
    labels = [(0.2, "highly aligned - working on same topic"), (0.5, "similar focus - related work"), (1.0, "different focus - parallel tracks")]
    out = F.when(d == float("inf"), "unknown (one or both agents not tracked)")
    for limit, label in labels:
        out = out.when(d < limit, label)
    return out.otherwise("divergent - unrelated or opposing")


def nearby(positions: DataFrame, agent: str, vector: str, own, threshold: float = 0.5) -> DataFrame:
    """(agent, distance) of the other agents within the threshold of one, nearest first; one pass, no pairs."""
    me = positions.filter(F.col(agent) == own).select(F.col(vector).alias("__me")).limit(1)
    others = positions.filter(F.col(agent) != own).crossJoin(F.broadcast(me))
    return others.select(agent, distance(F.col(vector), F.col("__me")).alias("distance")).filter(F.col("distance") < threshold)


def grid_statistics(positions: DataFrame, age: Column, speed: Column, stale: float = 300) -> DataFrame:
    return positions.agg(F.count(F.lit(1)).alias("total"), F.count_if(age < stale).alias("active"), F.count_if(age > stale).alias("stale"), F.round(F.avg(speed), 6).alias("mean_speed"))


def project(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x, y): two principal components, scaled to 0..1."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(data).transform(data)
    pcs = PCA(k=2, inputCol="c", outputCol="p").fit(centred).transform(centred).select(key, vector_to_array("p").alias("p"))
    span = pcs.agg(*[f(F.get("p", F.lit(i))).alias(f"{n}{i}") for i in (0, 1) for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda i: ((F.get("p", F.lit(i)) - F.col(f"lo{i}")) / (F.col(f"hi{i}") - F.col(f"lo{i}") + 1e-8))
    return pcs.crossJoin(F.broadcast(span)).select(key, scaled(0).alias("x"), scaled(1).alias("y"))


def sessions(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """(key, start, end, n): runs of events with gaps below the given seconds (a timer that each event sets anew)."""
    w = F.session_window(ts, f"{seconds} seconds")
    return events.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("end")).select(key, F.col("w.start").alias("start"), "end", "n")


def store_memory(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Rows (content, type, ...) with a checksum and counters; an unknown type fails the query."""
    known = F.col("type").isin(kinds)
    kept = rows.withColumn("type", F.when(known, F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown memory type: "), F.coalesce("type", F.lit("null"))))))
    return kept.withColumn("checksum", F.sha2("content", 256)).withColumn("version", F.lit(1)).withColumn("access_count", F.lit(0).cast("long"))


def coherence(positions: DataFrame, vector: str) -> DataFrame:
    """One row: agents, and the mean cosine of all pairs, from the sum of unit vectors (no pairs are made).

    The definition is this engine's own.
    """
    unit = positions.filter(norm(F.col(vector)) > 0).select(F.monotonically_increasing_id().alias("i"), F.transform(vector, lambda x: x / norm(F.col(vector))).alias("u"))
    sums = unit.select(F.posexplode("u").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    n = unit.agg(F.count(F.lit(1)).alias("agents"))
    return n.crossJoin(F.broadcast(sums)).select("agents", F.when(F.col("agents") > 1, (F.col("q") - F.col("agents")) / (F.col("agents") * (F.col("agents") - 1))).alias("coherence"))


def rounds(entries: DataFrame, key: str, number: str, agent: str) -> DataFrame:
    """(key, number, n, participants): contributions of each round, agents upper-cased, first seen first.

    Contributions are counted by agent first, so no more than the agents of a round are gathered.
    """
    each = entries.groupBy(key, number, F.upper(agent).alias("agent")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    named = F.transform(F.sort_array(F.collect_list(F.struct("first", "agent"))), lambda x: x["agent"])
    return each.groupBy(key, number).agg(F.sum("n").cast("int").alias("n"), named.alias("participants"))


def round_entries(entries: DataFrame, key: str, number: str, agent: str, content: str) -> DataFrame:
    """(key, number, place, agent, content): the contributions of each round as rows, numbered in order."""
    order = W.partitionBy(key, number).orderBy("seq")
    return entries.select(key, number, F.row_number().over(order).alias("place"), F.upper(agent).alias("agent"), F.col(content).alias("content"))


def payload_fields(rows: DataFrame, payload: str) -> DataFrame:
    """path, text and score of a remote hit's JSON payload, whose fields go by several names."""
    first = lambda *paths: F.coalesce(*[F.get_json_object(payload, p) for p in paths])
    node = F.get_json_object(payload, "$._node_content")
    return rows.withColumns({"path": first("$.file_path", "$.path", "$.source"), "text": F.coalesce(first("$.text", "$.content"), F.get_json_object(node, "$.text")), "score": F.round(first("$.score").cast("double"), 4)})
