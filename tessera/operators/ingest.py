"""Content hashes, duplicates, change detection, versions, tombstones, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def dedup(index: DataFrame, by_path: bool = True) -> DataFrame:
    """By path the last row stays, by hash the first; rows (path, hash, idx) are renumbered from 0 in their order.

    Numbers come from counts of range partitions, so no task sorts all rows.
    """
    kept = first_per(index, "path", F.desc("idx")) if by_path else first_per(index, "hash", F.asc("idx"))
    return renumber(kept, "idx")


def renumber(df: DataFrame, column: str, ties: list[str] = (), rows: int = 100_000) -> DataFrame:
    """Replaces an ordering column (a number) by 0, 1, 2, ... without a single sorting task: ranks within ranges of about
    `rows` rows, cut at quantiles whatever the skew, plus the rows of smaller ranges. Equal values go by `ties`."""
    n = df.count()
    cuts = sorted(set(df.approxQuantile(column, [i / (1 + n // rows) for i in range(1, 1 + n // rows)], 0.001 if n > rows else 0.01))) if n > rows else []
    cut = df.withColumn("__b", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(column))) if cuts else F.lit(0))
    sizes = cut.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__b", F.coalesce(F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = cut.withColumn("__r", F.row_number().over(W.partitionBy("__b").orderBy(column, *ties)) - 1)
    return ranked.join(F.broadcast(before), "__b").withColumn(column, (F.col("__r") + F.col("__before")).cast("long")).drop("__b", "__r", "__before")


def batch_add(known: DataFrame, new: DataFrame, cache: DataFrame, as_given: bool = False) -> DataFrame:
    """(id, hash, cached): the new rows whose hash is not known, those in the cache first.

    Rows of a batch that equal each other count once, unless `as_given`.
    """
    fresh = new.join(known.select("hash"), "hash", "left_anti")
    fresh = fresh if as_given else first_per(fresh, "hash", F.asc("id"))
    return fresh.join(cache.select("hash").distinct().withColumn("cached", F.lit(True)), "hash", "left").select("id", "hash", F.coalesce("cached", F.lit(False)).alias("cached"))


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): NEW, MODIFIED or DELETED; what is unchanged is left out."""
    a, b = old.select(key, F.col(value).alias("__old"), F.lit(1).alias("__o")), new.select(key, F.col(value).alias("__new"), F.lit(1).alias("__n"))
    change = F.when(F.col("__o").isNull(), "NEW").when(F.col("__n").isNull(), "DELETED").when(~F.col("__old").eqNullSafe(F.col("__new")), "MODIFIED")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change is not null")


def changed(store: DataFrame, new: DataFrame) -> DataFrame:
    """(path, is_changed, was_known) for new rows (path, hash): only live rows of the store are known."""
    live = store.filter(~F.col("deleted")).select("path", F.col("hash").alias("__h"))
    return new.join(live, "path", "left").select("path", (~F.col("__h").eqNullSafe(F.col("hash"))).alias("is_changed"), F.col("__h").isNotNull().alias("was_known"))


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store (path, hash, version, size, deleted) after the new rows (path, hash, size): a known path gets its next
    version and is live again."""
    fresh = new.select("path", F.col("hash").alias("__h"), F.col("size").alias("__s"), F.lit(True).alias("__new"))
    is_new = F.col("__new").isNotNull()
    return store.join(fresh, "path", "full").select(
        "path",
        F.when(is_new, F.col("__h")).otherwise(F.col("hash")).alias("hash"),
        F.when(is_new, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).alias("version"),
        F.when(is_new, F.col("__s")).otherwise(F.col("size")).alias("size"),
        F.when(is_new, F.lit(False)).otherwise(F.col("deleted")).alias("deleted"),
    )


def unchanged(stored: DataFrame, found: DataFrame) -> DataFrame:
    """The found rows whose mtime or size differs from the stored one, or that are new."""
    return found.join(stored.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def incremental_update(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index (id, path, hash, deleted) after new rows (seq, path, hash).

    A hash that a live row holds is a duplicate; else older rows of the path become tombstones and the row is appended.
    Of new rows with one path the last counts, of new rows with one hash the first.
    """
    live = index.filter(~F.col("deleted"))
    fresh = first_per(first_per(new, "path", F.desc("seq")), "hash", F.asc("seq")).join(live.select("hash"), "hash", "left_anti")
    top = index.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("__top"))
    added = renumber(fresh, "seq").crossJoin(F.broadcast(top)).select((F.col("seq") + F.col("__top")).alias("id"), "path", "hash", F.lit(False).alias("deleted"))
    marked = index.join(fresh.select("path", F.lit(True).alias("__gone")), "path", "left").select("id", "path", "hash", (F.col("deleted") | F.coalesce("__gone", F.lit(False))).alias("deleted"))
    return marked.unionByName(added)


def compact(index: DataFrame) -> DataFrame:
    """Live rows alone, renumbered from 0 in order of id."""
    return renumber(index.filter(~F.col("deleted")), "id")


def cached_embeddings(docs: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """docs with the cached embedding of (hash, model), null where there is none."""
    own = cache.filter(F.col("model") == model).select("hash", "embedding")
    return docs.join(own, "hash", "left")


def read_through(docs: DataFrame, cache: DataFrame, model: str, embed) -> DataFrame:
    """Embeddings of all docs; `embed` (text column to vector column) runs over distinct misses only."""
    both = cached_embeddings(docs, cache, model)
    hits = both.filter("embedding is not null")
    misses = both.filter("embedding is null").drop("embedding")
    computed = misses.dropDuplicates(["hash"]).select("hash", embed(F.col("text")).alias("embedding"))
    return hits.unionByName(misses.join(computed, "hash").select(*hits.columns))


def prune(cache: DataFrame, today: Column, days: int) -> DataFrame:
    return cache.filter(F.col("last_used") >= today - F.expr(f"INTERVAL {days} DAYS"))


def store_statistics(store: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: live and deleted documents, chunks, bytes of live documents."""
    s = store.agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("deleted"), F.coalesce(F.sum(F.when(~F.col("deleted"), F.col("size"))), F.lit(0)).alias("bytes"))
    return s.crossJoin(F.broadcast(chunks.agg(F.count(F.lit(1)).alias("chunks"))))
