"""Mergeable replicated state: vector clocks, last-writer-wins registers and maps, observed-remove sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clock_increment(clock: Column, agent: str) -> Column:
    one = F.create_map(F.lit(agent), F.lit(1).cast("long"))
    return F.map_zip_with(clock, one, lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def clock_merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def clock_compare(a: Column, b: Column) -> Column:
    """EQUAL, A_BEFORE_B, B_BEFORE_A or CONCURRENT; a missing agent counts 0."""
    both = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    less, more = F.exists(both, lambda d: d < 0), F.exists(both, lambda d: d > 0)
    return F.when(less & more, "CONCURRENT").when(less, "A_BEFORE_B").when(more, "B_BEFORE_A").otherwise("EQUAL")


def clocks(rows: DataFrame, key: str, agent: str, count: str) -> DataFrame:
    """(key, clock): the key-wise greatest counts of many replicas."""
    each = rows.groupBy(key, agent).agg(F.max(count).cast("long").alias("n"))
    return each.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(agent, "n")))).alias("clock"))


def lww_register(rows: DataFrame, key: str, value: str, ts: str, writer: str) -> DataFrame:
    """(key, value, ts, writer): the latest write with ts > 0; equal times go to the greater writer, in any order of merging."""
    live = rows.filter(F.col(ts) > 0)
    best = F.max_by(F.struct(F.col(value).alias("value"), F.col(ts).alias("ts"), F.col(writer).alias("writer")), F.struct(ts, writer))
    return live.groupBy(key).agg(best.alias("w")).select(key, "w.*")


def lww_map(rows: DataFrame, entity: str, key: str, value: str, ts: str, writer: str) -> DataFrame:
    """(entity, key, value, ts, writer) of live keys: a null value is a removal."""
    best = F.max_by(F.struct(F.col(value).alias("value"), F.col(ts).alias("ts"), F.col(writer).alias("writer")), F.struct(ts, writer))
    return rows.groupBy(entity, key).agg(best.alias("w")).select(entity, key, "w.*").filter("value is not null")


def orset_value(adds: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct elements with a tag that is no tombstone; replicas merge by union of both tables."""
    return adds.distinct().join(tombstones.select("tag").distinct(), "tag", "left_anti").select(*keys, "element").distinct()


def orset_remove(adds: DataFrame, tombstones: DataFrame, removed: DataFrame) -> DataFrame:
    """The tombstones after elements are removed: all tags seen for them so far."""
    return tombstones.select("tag").union(adds.join(removed, "element", "left_semi").select("tag")).distinct()


def envelope(kind: str, *fields: str) -> Column:
    """JSON of a replica: its type and data."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*fields).alias("data")))
