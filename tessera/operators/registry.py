"""A registry of claims with vector clocks, votes on them, and requests to settle conflicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crdt import clock_compare


def classify(status: Column, old_hash: Column, new_hash: Column, old: Column, new: Column) -> Column:
    """What a registration meets: new, frozen, conflict, merged, stale or accepted."""
    order = clock_compare(old, new)
    return F.when(old_hash.isNull(), "new").when(status == "frozen", "frozen").when((order == "CONCURRENT") & (old_hash == new_hash), "merged").when(order == "CONCURRENT", "conflict").when(order == "B_BEFORE_A", "stale").otherwise("accepted")


def priority(kind: Column) -> Column:
    return F.when(F.lower(kind).isin("adr", "protocol"), "high").otherwise("medium")


def request(conflicts: DataFrame, minutes: int = 30) -> DataFrame:
    """Adds priority and timeout_at to conflicts (kind, created_at)."""
    return conflicts.withColumn("priority", priority(F.col("kind"))).withColumn("timeout_at", F.col("created_at") + F.expr(f"INTERVAL {minutes} MINUTES"))


def timed_out(requests: DataFrame, now: Column) -> DataFrame:
    return requests.withColumn("status", F.when((F.col("status") == "pending") & (F.col("timeout_at") < now), "timeout").otherwise(F.col("status")))


def outcome(votes: DataFrame, key: str, approve: str) -> DataFrame:
    """(key, approvals, rejections, outcome): unanimous also if all reject; no row's vote may be null."""
    t = votes.groupBy(key).agg(F.count_if(approve).alias("approvals"), F.count_if(~F.col(approve)).alias("rejections"))
    kind = F.when(F.col("approvals") + F.col("rejections") == 0, "NO_VOTE").when((F.col("approvals") == 0) | (F.col("rejections") == 0), "UNANIMOUS").when(F.col("approvals") > F.col("rejections"), "MAJORITY_APPROVE").when(F.col("approvals") < F.col("rejections"), "MAJORITY_REJECT").otherwise("SPLIT")
    return t.withColumn("outcome", kind)


def freeze(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Proposed and active entries of the given ids become frozen."""
    hit = entries.join(ids.select("id", F.lit(True).alias("__f")), "id", "left")
    return hit.withColumn("status", F.when(F.col("__f") & F.col("status").isin("proposed", "active"), "frozen").otherwise(F.col("status"))).drop("__f")


def replay(events: DataFrame) -> DataFrame:
    """(entry, seq, result) of registrations (entry, seq, agent, hash, clock map, freeze), folded in order for each entry.

    The agent's own count grows by one with each of its registrations; accepted ones merge into the entry's clock.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        clock, held, frozen, out = {}, None, False, []
        for row in frame.sort_values("seq").itertuples():
            given = {k: int(v) for k, v in (row.clock or {}).items()} if row.clock is not None else dict(clock)
            given[row.agent] = given.get(row.agent, 0) + 1
            less = any(clock.get(k, 0) < v for k, v in given.items())
            more = any(v > given.get(k, 0) for k, v in clock.items())
            if held is None:
                result = "new"
            elif frozen:
                result = "frozen"
            elif less and more:
                result = "merged" if row.hash == held else "conflict"
            elif more:
                result = "stale"
            else:
                result = "accepted"
            if result in ("new", "merged", "accepted"):
                clock = {k: max(clock.get(k, 0), given.get(k, 0)) for k in {*clock, *given}}
                held = row.hash
            frozen |= bool(row.freeze)
            out.append((row.entry, row.seq, result))
        return pd.DataFrame(out, columns=["entry", "seq", "result"])

    return events.groupBy("entry").applyInPandas(fold, f"entry {dict(events.dtypes)['entry']}, seq long, result string")
