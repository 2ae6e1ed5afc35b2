"""The document store end to end: chunk registry, lookups, indexing and deleting files, recovery, manifests."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_hash, language
from . import chunk, ingest, log


class State(NamedTuple):
    """store (path, hash, version, size, deleted), chunks (path, chunk_index, hash, size), index (id, path, hash, deleted)
    with a row for each chunk, and log (operation, doc_id, payload, checksum, applied) of one batch."""

    store: DataFrame
    chunks: DataFrame
    index: DataFrame
    log: DataFrame


def live(store: DataFrame) -> DataFrame:
    return store.filter(~F.col("deleted"))


def lookup(store: DataFrame, paths: DataFrame) -> DataFrame:
    """The live documents with the given paths."""
    return live(store).join(paths.select("path"), "path", "left_semi")


def listing(store: DataFrame, language_: str | None = None, k: int | None = None) -> DataFrame:
    """Live documents, of one language if given, by path."""
    found = live(store).withColumn("language", language(F.col("path")))
    found = found.filter(F.col("language") == language_) if language_ else found
    return found.orderBy("path").limit(k) if k else found


def register_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The registry after the new chunks: those of a path replace all that it had."""
    return chunks.join(new.select("path").distinct(), "path", "left_anti").unionByName(new.select(*chunks.columns))


def chunk_counts(store: DataFrame, chunks: DataFrame) -> DataFrame:
    """Live documents with the number of their chunks."""
    n = chunks.groupBy("path").agg(F.count(F.lit(1)).alias("chunk_count"))
    return live(store).join(n, "path", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long")))


def soft_delete(store: DataFrame, paths: DataFrame) -> DataFrame:
    gone = paths.select("path", F.lit(True).alias("__gone")).distinct()
    return store.join(gone, "path", "left").withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False))).drop("__gone")


def purge(store: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the documents flagged as deleted, and without their chunks."""
    kept = live(store)
    return kept, chunks.join(kept.select("path").distinct(), "path", "left_semi")


def remove(index: DataFrame, paths: DataFrame) -> DataFrame:
    """Tombstones for all rows of the paths; their hashes are known no more, since only live rows' are."""
    return soft_delete(index, paths)


def migrate(rows: DataFrame) -> DataFrame:
    """An index (id, path, hash, deleted) of all rows (seq, path, hash) as they are, duplicates too."""
    return ingest.renumber(rows, "seq").select(F.col("seq").alias("id"), "path", "hash", F.lit(False).alias("deleted"))


def _entries(rows: DataFrame, operation: str, payload: Column) -> DataFrame:
    op = F.lit(operation)
    out = rows.select(op.alias("operation"), F.col("path").alias("doc_id"), payload.alias("payload"))
    return out.withColumn("checksum", log.checksum(op, F.col("doc_id"), F.col("payload"))).withColumn("applied", F.lit(True))


def index_files(state: State, files: DataFrame) -> State:
    """After new or changed files (path, text): the log's entries, the next version of each document, its chunks, and an
    index whose older rows of the path are tombstones. Files whose content is known to the store change nothing."""
    hashed = files.select("path", "text", content_hash(F.col("text"), 16).alias("hash"), F.length("text").cast("long").alias("size"))
    changed = ingest.changed(state.store, hashed).filter("is_changed").select("path")
    fresh = hashed.join(changed, "path", "left_semi")
    entries = _entries(fresh, "index", F.to_json(F.struct("hash", "size")))
    parts = chunk.fixed(fresh, "path", "text")
    parts = parts.select(F.substring_index("path", "#chunk", 1).alias("path"), F.col("chunk").alias("chunk_index"), content_hash(F.col("content"), 16).alias("hash"), F.length("content").cast("long").alias("size"))
    top = state.index.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("__top"))
    order = F.xxhash64("path").alias("__order")
    numbered = ingest.renumber(parts.select("path", "hash", F.struct(F.col("path"), F.col("chunk_index")).alias("__key"), order), "__order", ["__key"])
    added = numbered.crossJoin(F.broadcast(top)).select((F.col("__order") + F.col("__top")).alias("id"), "path", "hash", F.lit(False).alias("deleted"))
    return State(
        ingest.upsert(state.store, fresh.select("path", "hash", "size")),
        register_chunks(state.chunks, parts),
        remove(state.index, fresh).select("id", "path", "hash", "deleted").unionByName(added),
        state.log.unionByName(entries),
    )


def delete_files(state: State, paths: DataFrame) -> State:
    """After the deletion of live documents: log entries, tombstones in store and index; chunks stay until a purge."""
    known = lookup(state.store, paths).select("path")
    entries = _entries(known, "delete", F.lit("{}"))
    return State(soft_delete(state.store, known), state.chunks, remove(state.index, known), state.log.unionByName(entries))


def path_cache(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """docs (path, hash) with the embedding that the cache (path, hash, embedding) holds for the path, if its content is
    still the same."""
    return docs.join(cache.select("path", "hash", F.col("embedding")), ["path", "hash"], "left")


def rebuild(docs: DataFrame) -> DataFrame:
    """The state (doc_id, payload) from the document table alone."""
    return docs.select("doc_id", "payload")


def recover(snapshot: tuple[DataFrame, int] | None, entries: DataFrame, docs: DataFrame | None, slack: int = 100) -> tuple[DataFrame, str]:
    """(state, how): the snapshot with the log replayed on it, if it agrees with the documents in number; else rebuilt
    from them; without documents what the snapshot gives, else nothing."""
    if snapshot is not None:
        state = log.replay(snapshot[0], entries, snapshot[1])
        if docs is None or log.consistent(state, docs, slack).first()["consistent"]:
            return state, "snapshot"
    if docs is not None:
        return rebuild(docs), "rebuilt"
    return entries.select("doc_id", "payload").limit(0), "empty"


def status(entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: entries, pending ones, snapshots and the newest's name."""
    a = entries.agg(F.count(F.lit(1)).alias("entries"), F.count_if(~F.col("applied")).alias("pending"))
    b = snapshots.agg(F.count(F.lit(1)).alias("snapshots"), F.max("name").alias("newest"))
    return a.crossJoin(F.broadcast(b))


class Bloom:
    """A filter of two bits a key; its set bits, at most `bits` rows, are all that is broadcast."""

    def __init__(self, keys: DataFrame, key: Column, bits: int = 8192):
        from ..functions.text import bloom_bits

        self._bits, self.bits = bloom_bits, bits
        self.set = keys.select(F.explode(bloom_bits(key, bits)).alias("bit")).distinct()

    def probe(self, rows: DataFrame, key: Column, out: str = "maybe") -> DataFrame:
        """Adds `out`: false for keys that are surely not held."""
        held = F.broadcast(self.set.agg(F.sort_array(F.collect_list("bit")).alias("__set")))
        both = rows.crossJoin(held)
        return both.withColumn(out, F.size(F.array_intersect(F.array_distinct(self._bits(key, self.bits)), "__set")) == F.size(F.array_distinct(self._bits(key, self.bits)))).drop("__set")


def start_sessions(active: DataFrame, new: DataFrame) -> DataFrame:
    """(id, error): new sessions, with an error for an id that is active or comes twice."""
    n = new.withColumn("__n", F.row_number().over(W.partitionBy("id").orderBy("seq")))
    known = active.select("id", F.lit(True).alias("__known")).distinct()
    clash = F.coalesce("__known", F.lit(False)) | (F.col("__n") > 1)
    return n.join(known, "id", "left").select("id", "seq", F.when(clash, "duplicate id").alias("error"))


def verify_checksums(rows: DataFrame, content: str = "content", checksum: str = "checksum") -> DataFrame:
    return rows.withColumn("valid", F.coalesce(content_hash(F.col(content)) == F.col(checksum), F.lit(False)))
