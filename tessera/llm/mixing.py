"""Operator 5: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources share the words of all documents by weight; a target stops at `most` times its source's size, and the
excess is shared anew by weight until none is above. A source is cut into blocks by a permuting hash; its target is a
number of whole passes over its blocks and a partial pass that ends within one document. A binary tree over the output
shards splits the exact numbers of block copies: at each node the left half draws its share from all sources without
replacement, so shards are equal in blocks and random in composition. Each source's copies, in permuted order, then go
to the shards by these numbers, and each shard is shuffled on its own.

Null texts and texts without words have size 0 and are taken as such; null sources are one source, ordered last. With
`whole`, documents are taken whole only: those that fit in order, then the one whose size is nearest to what is due.
Rows with the same id are told apart by their texts and sources, by 128 bits; rows equal in the three are taken each
by itself in the plan, and as one in the mix, which shows them as often as they are taken together. Of other columns
only the mix reads any; one that has the name of its shard column is replaced. An empty table gives an empty result.
Results do not depend on partitioning, so reruns agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, ordered_rank, table

#: Strata of the splitting tree (sources beyond share strata), documents of a block, and blocks of a source at most.
STRATA, BLOCK_DOCS, MOST_BLOCKS = 4096, 500, 65_536
#: Block copies of one hypergeometric draw (numpy takes fewer than 10**9), and words that a task of the mix holds.
DRAWN, TASK_WORDS = 500_000_000, 4_000_000

WORD = r"[^\x20\x09-\x0D]+"


def targets(scratch: Scratch, sources: DataFrame, weights: Column, most: int = 3) -> DataFrame:
    """(source, source_size, docs) with place (by code point, null last), weight and target."""
    ranked = scratch.write(ordered_rank(scratch, sources, [F.col("source").asc_nulls_last()], "place").withColumn("weight", weights))
    level = -1.0
    while True:  # the level per weight rises until no further source meets its limit
        full = (F.col("weight") * level > most * F.col("source_size")) if level >= 0 else F.lit(False)
        total, capped, weight = ranked.agg(F.sum("source_size"), F.sum(F.when(full, most * F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        after = ((total or 0) - (capped or 0)) / weight if weight else float("inf")
        if after == level:
            break
        level = after
    if level == float("inf"):
        return ranked.withColumn("target", (most * F.col("source_size")).cast("double"))
    return ranked.withColumn("target", F.least(F.col("weight") * level, (most * F.col("source_size")).cast("double")).cast("double"))


def split_counts(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(stratum, shard) counts: each node gives its left half a multivariate hypergeometric draw."""
    rng, out = np.random.default_rng(seed), np.zeros((len(counts), shards), np.int64)

    def split(own: np.ndarray, a: int, b: int) -> None:
        if b - a == 1:
            out[:, a] = own
            return
        mid = (a + b) // 2
        n = int(own.sum())
        left = _draw(rng, own, n * (mid - a) // (b - a)) if n else own
        split(left, a, mid)
        split(own - left, mid, b)

    split(counts.astype(np.int64), 0, shards)
    return out


def _draw(rng: np.random.Generator, own: np.ndarray, n: int) -> np.ndarray:
    """n of sum(own) without replacement; beyond DRAWN, from equal parts in turn, by each one's share."""
    total, parts = int(own.sum()), int(own.sum()) // DRAWN + 1
    out, seen, taken = np.zeros_like(own), 0, 0
    for i in range(parts):
        part = own // parts + (i < own % parts)
        seen += int(part.sum())
        due = n * seen // total - taken
        taken += due
        out += rng.multivariate_hypergeometric(part, due, method="marginals")
    return out


def _keys(seed: int) -> list[Column]:
    """128 bits of a row's id, source and text; nulls differ from all values."""
    own = [F.col("doc_id"), F.col("source"), F.col("text")]
    return [F.xxhash64(*own, *[c.isNull() for c in own], F.lit(s)).alias(name) for name, s in (("key", seed), ("key2", seed + 1))]


class Mix:
    def __init__(self, docs: DataFrame, shards: int = 16, seed: int = 5, whole: bool = False, weights: Column | None = None, most: int = 3):
        self.docs, self.shards, self.seed, self.whole = docs, shards, seed, whole
        self.scratch = Scratch(docs.sparkSession, "mix")
        self.weights, self.most = weights if weights is not None else F.col("place") % 3 + 1, most

    def plan(self) -> DataFrame:
        """doc_id, source, size, source_size, target, key, key2, and copies: (shard, place, words) of each time it is taken."""
        scratch, seed = self.scratch, self.seed
        size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
        state = scratch.write(self.docs.select("doc_id", "source", size.alias("size"), *_keys(seed)))
        sources = state.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
        aims = targets(scratch, sources, self.weights, self.most)
        passes = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
        blocks = F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("long")
        aims = aims.withColumn("passes", passes).withColumn("rest", (F.round("target") - F.col("passes") * F.col("source_size")).cast("long")).withColumn("blocks", blocks)
        aims = scratch.write(aims.withColumn("stratum", (F.col("place") % STRATA).cast("int")))
        same = lambda a, b: a["source"].eqNullSafe(b["source"])
        joined = state.join(aims, same(state, aims)).drop(aims["source"])
        joined = joined.withColumn("block", F.shiftright(F.shiftrightunsigned("key", 33) * F.col("blocks"), 31))
        sums = joined.groupBy("place", "block").agg(F.sum("size").alias("block_size"))
        sums = sums.withColumn("base", F.coalesce(F.sum("block_size").over(W.partitionBy("place").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        inner = W.partitionBy("place", "block").orderBy("key", "key2").rowsBetween(W.unboundedPreceding, W.currentRow)
        placed = joined.withColumn("before", F.sum("size").over(inner) - F.col("size")).join(sums.select("place", "block", "base"), ["place", "block"])
        before = F.col("base") + F.col("before")
        if self.whole:
            placed = scratch.write(placed.withColumn("fits", (F.col("size") > 0) & (before + F.col("size") <= F.col("rest"))))
            # tables of a row for each source, so that Spark can split a large source's side of the joins
            gap = scratch.write(placed.groupBy("place").agg((F.first("rest") - F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))).alias("gap")))
            near = placed.filter("not fits and size > 0").join(gap, "place").withColumn("off", F.abs(F.col("size") - F.col("gap"))).filter("off < gap")
            last = scratch.write(near.groupBy("place").agg(F.min(F.struct("off", "key", "key2", "block")).alias("last")))
            placed = placed.join(last, "place", "left")
            taken = F.col("fits") | ((F.col("key") == F.col("last.key")) & (F.col("key2") == F.col("last.key2")))
            partial = F.when(F.coalesce(taken, F.lit(False)), F.col("size")).otherwise(0)
            sums = sums.join(last.select("place", F.col("last.block").alias("last")), "place", "left")
        else:
            partial = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
        units = self._units(sums, aims)
        placed = placed.withColumn("partial", partial.cast("long")).join(units, ["place", "block"], "left")
        words = lambda u: F.when(u["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("partial"))
        copies = F.transform(F.coalesce("units", F.array().cast("array<struct<pass:int,shard:int,k:long>>")), lambda u: F.struct(u["shard"].alias("shard"), u["k"].alias("place"), words(u).alias("words")))
        return placed.select("doc_id", "source", "size", "source_size", "target", "key", "key2", F.filter(copies, lambda c: c["words"] > 0).alias("copies"))

    def _units(self, sums: DataFrame, aims: DataFrame) -> DataFrame:
        """(place, block, units): the shard of each copy of a block, by pass."""
        reach = F.col("passes") + ((F.col("base") < F.col("rest")) | (F.coalesce(F.col("last") == F.col("block"), F.lit(False)) if self.whole else F.lit(False))).cast("int")
        each = sums.join(aims.select("place", "stratum", "passes", "rest"), "place").withColumn("n", reach).filter("n > 0")
        each = self.scratch.write(each.select("place", "stratum", "block", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("pass")))
        counts = np.zeros(STRATA, np.int64)
        for stratum, n in each.groupBy("stratum").agg(F.count(F.lit(1))).collect():  # at most STRATA rows
            counts[stratum] = n
        used = int(counts.nonzero()[0].max()) + 1 if counts.any() else 1
        ends = np.cumsum(split_counts(counts[:used], self.shards, self.seed), axis=1)
        rows = self.docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ends.tolist())], "stratum int, ends array<long>")
        order = W.partitionBy("stratum").orderBy(F.xxhash64("place", "block", "pass", F.lit(self.seed)), "place", "block", "pass")
        dealt = each.withColumn("k", (F.row_number().over(order) - 1).cast("long")).join(F.broadcast(rows), "stratum")
        dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("k"))))
        return dealt.groupBy("place", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "k"))).alias("units"))

    def mixed(self, shard_col: str | None = "shard") -> DataFrame:
        """The documents as often as they are taken, with all columns and their shard; a shard's rows lie together, shuffled.

        Documents are taken whole here.
        """
        names = [n for n in self.docs.columns if n != shard_col]
        keyed = self.docs.select(F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]).alias("row"), *_keys(self.seed))
        plan = self.scratch.write(self.plan().groupBy("key", "key2").agg(F.flatten(F.collect_list("copies")).alias("copies")).filter(F.size("copies") > 0))
        words = plan.agg(F.sum(F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"]))).first()[0] or 0
        parts = max(8, -(-words // (self.shards * TASK_WORDS)))
        tasks = max(self.shards * parts, int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = keyed.groupBy("key", "key2").agg(F.first("row").alias("row"))
        out = rows.join(plan.select("key", "key2", F.explode("copies").alias("copy")), ["key", "key2"]).select("row", "copy.shard", F.xxhash64("key", "key2", "copy.place", F.lit(self.seed)).alias("turn"))
        out = out.repartition(tasks, "shard", F.pmod("turn", F.lit(parts))).sortWithinPartitions("shard", "turn")
        return out.select(*[F.col(f"row.c{i}").alias(n) for i, n in enumerate(names)], *([F.col("shard").alias(shard_col)] if shard_col else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is taken of each document, as the tree has dealt it to the shards (`shards`: one for each time it is taken)."""
    plan = Mix(table(spark, sf_dir, "documents")).plan()
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.transform("copies", lambda c: c["shard"]).alias("shards"))
