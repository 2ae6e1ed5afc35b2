"""Operator 4: balanced label propagation over linked documents, in DataFrame operations alone.

Documents start in shards that are equal in rows and random otherwise. Documents of equal texts are linked; a group of
links too large for a fraction of a shard is cut by a hash into parts that aim at neighbouring shards. In each round a
document wants the shard that holds most of its part. A wish from shard i to j is granted against a wish from j to i,
or against a document of j without links, so no shard ever changes its number of rows (law `rows`). A granted document
wishes no more, and others' majorities only grow, so rounds come to an end: when no wish is left or none can be granted
(`left` has the number of those). Counts of wishes (shards squared of them) are all that reaches the driver. Groups and
parts that hold more than one in HOT of all documents, at most as many as that, meet their documents by broadcast.

Null and empty texts have size 8 and are linked with each other. Rows are told apart by nothing but their values: equal
rows are separate documents. Null ids are placed like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, salted_rank, table

#: Rows that one task ranks.
RANKED = 50_000
#: Groups or parts with a larger share of all rows than one in HOT are never dealt out by their key.
HOT = 4096
#: Parts that a large group makes for each shard it aims at.
PARTS = 64


def _high(key: Column | str, n: int) -> Column:
    """A salt below n that grows with the hash."""
    return F.shiftright(F.shiftrightunsigned(key, 33) * n, 31)


def grants(wishes: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> tuple[list[list[int]], list[list[int]]]:
    """How many wishes from i to j are granted, and, for each shard, the ends of the ranges of its unlinked documents
    that go to shard 0, 1, ... in exchange."""
    granted = [[0] * shards for _ in range(shards)]
    ends = []
    for j in range(shards):
        left, line, at = free.get(j, 0), [], 0
        for i in range(shards):
            there, back = wishes.get((i, j), 0), wishes.get((j, i), 0)
            swaps = min(there, back)
            paid = min(left, there - swaps)
            granted[i][j] = swaps + paid
            left -= paid
            at += paid
            line.append(at)
        ends.append(line)
    return granted, ends


def _grid(rows: list[list[int]]) -> Column:
    return F.array(*[F.array(*[F.lit(x).cast("long") for x in line]) for line in rows])


class Propagation:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, seed: int = 4):
        self.docs, self.id, self.text, self.shards, self.seed = docs, id_col, text_col, shards, seed
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "shard")

    def run(self) -> DataFrame:
        """id, size, text_crc32, law, shard, slot, grown_shard of every row."""
        scratch, shards = self.scratch, self.shards
        raw = F.coalesce(F.col(self.text), F.lit("")).cast("binary")
        base = self.docs.select(F.col(self.id).alias("id"), (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("crc"), F.xxhash64(raw).alias("g"))
        base = scratch.write(base.withColumn("u", F.xxhash64("id", "g", F.lit(self.seed))))
        n = base.count()
        salts = 1 + n // RANKED
        quota = max(1, n // shards)
        # a large group aims at as many shards as it fills to four fifths, in many parts each
        groups = base.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        wide = F.when(F.col("m") > quota // 4, F.least(F.lit(shards), F.ceil(F.col("m") / (0.8 * quota)))).otherwise(0).cast("int")
        most = n // HOT
        groups = groups.select("g", wide.alias("wide"), (F.col("m") > most).alias("hot"))
        groups = scratch.write(groups.withColumn("parts", F.greatest(F.lit(1), F.col("wide") * PARTS)))
        part = F.pmod(F.xxhash64("u", F.lit(1)), F.col("parts"))
        aim = F.when(F.col("wide") > 0, F.pmod(F.xxhash64("g", F.lit(self.seed)) + F.floor(part / PARTS), F.lit(shards))).cast("int")
        hot = F.broadcast(groups.filter("hot"))  # HOT rows at most
        state = base.join(hot, "g").unionByName(base.join(hot, "g", "left_anti").join(groups.filter("not hot"), "g", "left"))
        state = state.withColumn("part", F.when(F.col("parts").isNotNull(), F.xxhash64("g", part))).withColumn("aim", aim).withColumn("hot", F.coalesce("hot", F.lit(False)))
        state = salted_rank(self.spark, state.drop("wide", "parts"), [], [F.col("u"), F.col("id"), F.col("size")], salts, _high("u", salts), "place")
        state = scratch.write(state.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).drop("place"))
        while True:
            held = state.filter("part is not null").groupBy("part", "hot", "aim", "shard").agg(F.count(F.lit(1)).alias("m"))
            most = F.max_by("shard", F.struct("m", F.xxhash64("part", "shard")))
            wants = scratch.write(held.groupBy("part", "hot").agg(F.coalesce(F.first("aim"), most).alias("want")))
            linked = state.filter("part is not null")
            few = F.broadcast(wants.filter("hot").drop("hot"))  # the parts of HOT groups, and PARTS for each shard that large ones fill
            linked = linked.filter("hot").join(few, "part").unionByName(linked.filter("not hot").join(wants.filter("not hot").drop("hot"), "part"))
            linked = linked.withColumn("want", F.when(F.col("want") != F.col("shard"), F.col("want")))
            free = state.filter("part is null").withColumn("want", F.lit(None).cast("int"))
            asked = scratch.write(linked.unionByName(free))
            counts = asked.filter("part is null or want is not null").groupBy("shard", F.coalesce("want", F.lit(-1)).alias("want")).agg(F.count(F.lit(1))).collect()
            wishes = {(i, j): c for i, j, c in counts if j >= 0}
            granted, ends = grants(wishes, {i: c for i, j, c in counts if j < 0}, shards)
            self.left = sum(wishes.values())
            scratch.drop(wants)
            if not any(map(any, granted)):
                break
            kind = F.when(F.col("want").isNotNull(), F.col("want")).when(F.col("part").isNull(), F.lit(-1)).otherwise(F.lit(-2))
            kinds = asked.withColumn("kind", kind)
            moving = salted_rank(self.spark, kinds.filter("kind > -2"), ["shard", "kind"], [F.col("part"), F.col("u"), F.col("id"), F.col("size")], salts, _high(F.coalesce("part", "u"), salts), "place")
            to = F.when((F.col("kind") >= 0) & (F.col("place") < F.get(F.get(_grid(granted), F.col("shard")), F.col("kind"))), F.col("kind"))
            line = F.get(_grid(ends), F.col("shard"))
            freed = F.size(F.filter(line, lambda e: e <= F.col("place")))
            to = to.when((F.col("kind") == -1) & (freed < shards), freed)
            names = ["id", "size", "crc", "g", "u", "part", "aim", "hot"]
            moved = moving.select(*names, F.coalesce(to, F.col("shard")).cast("int").alias("shard"))
            before, state = state, scratch.write(moved.union(kinds.filter("kind = -2").select(*names, "shard")))
            scratch.drop(before, asked)
        out = salted_rank(self.spark, state, ["shard"], [F.col("u"), F.col("id"), F.col("size")], salts, _high("u", salts), "slot")
        return out.select(F.col("id").alias(self.id), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Propagation(table(spark, sf_dir, "documents")).run()
