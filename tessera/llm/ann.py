"""Operator 3: approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a sample of at most `sample` vectors (those with the smallest hashes of id; a documented bound),
every vector is then assigned to a leaf. A query walks the tree best bin first through a priority queue, by the inner
product with the centres plus a share of the radius. Leaf visits widen until calibration queries, whose true neighbours
come from an exact pass over all rows, reach the recall asked for. Leaves are searched in bounded blocks of vectors
and queries, so one vector held by a third of all rows fills many blocks and no single task.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than
the most frequent one (the smaller, if tied), nor null ids. Rows repeated with id and vector count once; a query never
meets its own id. Empty tables give no rows; only the id and vector columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, mapped, table

BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


class Tree:
    """Nodes of a k-means tree: centres, radii, and children as ranges; leaves are numbered by themselves."""

    def __init__(self, x: np.ndarray, branch: int = 8, leaf: int = 64, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.centre, self.radius, self.children = [x.mean(0)], [float(np.sqrt(((x - x.mean(0)) ** 2).sum(1)).max())], [()]
        todo = [(0, x)]
        while todo:
            node, own = todo.pop()
            if len(own) <= leaf:
                continue
            parts = _lloyd(own, min(branch, -(-len(own) // leaf) + 1), rng)
            if len(parts) < 2:
                continue
            numbers = []
            for part in parts:
                numbers.append(len(self.centre))
                c = part.mean(0)
                self.centre.append(c)
                self.radius.append(float(np.sqrt(((part - c) ** 2).sum(1)).max()))
                self.children.append(())
                todo.append((numbers[-1], part))
            self.children[node] = tuple(numbers)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.leaves = np.array([i for i, c in enumerate(self.children) if not c])
        self.number = {int(n): i for i, n in enumerate(self.leaves)}

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf to which the nearest centre of each level leads."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.number[node]
                continue
            c = self.centre[list(self.children[node])]
            nearest_ = np.argmin((c**2).sum(1) - 2 * (x[rows] @ c.T), axis=1)
            todo += [(child, rows[nearest_ == i]) for i, child in enumerate(self.children[node]) if (nearest_ == i).any()]
        return out

    def walk(self, q: np.ndarray, least_leaves: int, sizes: np.ndarray, least_rows: int) -> list[int]:
        """Leaves, best bin first, until there are enough of them and of rows in them."""
        promise = self.centre @ q + 0.3 * np.sqrt(q @ q) * self.radius
        heap, out, rows = [(-promise[0], 0)], [], 0
        while heap and (len(out) < least_leaves or rows < least_rows):
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-promise[child], child))
            else:
                leaf = self.number[node]
                if sizes[leaf]:
                    out.append(leaf)
                    rows += int(sizes[leaf])
        return out


def _lloyd(x: np.ndarray, k: int, rng, rounds: int = 8) -> list[np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)
        centres = np.array([x[own == i].mean(0) for i in range(len(centres)) if (own == i).any()])
    own = np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)
    return [x[own == i] for i in range(len(centres)) if (own == i).any()]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, id, score) of the k best for each query; equal vectors get equal scores."""
    rough, out = q @ x.T, []
    for i, own in enumerate(q_ids.tolist()):
        line = rough[i].copy()
        line[ids == own] = -np.inf
        usable = int((line > -np.inf).sum())
        if not usable:
            continue
        cut = np.partition(line, len(line) - min(k, usable))[len(line) - min(k, usable)]
        at = np.flatnonzero(line >= cut - 1e-9 * (1 + abs(cut)))
        score = (x[at] * q[i]).sum(1)
        best = np.lexsort((ids[at], -score))[:k]
        out += zip([own] * len(best), ids[at][best].tolist(), score[best].tolist())
    return out


def _top(df: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Index:
    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 16_384, branch: int = 8, leaf: int = 64):
        self.spark = vectors.sparkSession
        self.scratch = Scratch(self.spark, "ann")
        usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).filter("vec_id is not null and x is not null")
        usable = usable.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0))
        lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
        self.width = lengths[0] if lengths else 0
        usable = usable.filter(F.size("x") == self.width).distinct()
        self.tree, self.sizes = None, np.zeros(0, np.int64)
        if not self.width:
            return
        picked = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").toArrow()
        self.tree = Tree(matrix(picked["x"], self.width), branch, leaf)
        tree, width = self.spark.sparkContext.broadcast(self.tree), self.width

        def assign(batches) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.value.assign(matrix(b.column(1), width)), pa.int32())], ["vec_id", "x", "leaf"])

        self.rows = self.scratch.write(mapped(usable, assign, "vec_id long, x array<double>, leaf int"))
        self.sizes = np.zeros(len(self.tree.leaves), np.int64)
        for leaf_, n in self.rows.groupBy("leaf").agg(F.count(F.lit(1))).collect():  # a row for each leaf of the tree
            self.sizes[leaf_] = n

    def calibrate(self, is_query: Column, k: int, recall: float, queries: int = 200) -> tuple[int, float]:
        """Leaves to visit so that `queries` queries find `recall` of their true neighbours on average."""
        some = self.rows.filter(is_query).orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(queries).select("vec_id", "x").toArrow()
        if not some.num_rows:
            return 1, 1.0
        width, tree = self.width, self.tree
        q, q_ids = matrix(some["x"], width), np.asarray(some["vec_id"])
        given = self.spark.sparkContext.broadcast((q, q_ids))

        def exact(batches) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, BLOCK_ROWS):
                    part = b.slice(at, BLOCK_ROWS)
                    ids, leaves = np.asarray(part.column(0)), np.asarray(part.column(2))
                    found = nearest(*given.value, matrix(part.column(1), width), ids, k)
                    place = dict(zip(ids.tolist(), leaves.tolist()))
                    cols = list(zip(*found)) or [()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array([place[i] for i in cols[1]], pa.int32())], ["query_id", "vec_id", "score", "leaf"])

        true = _top(mapped(self.rows, exact, "query_id long, vec_id long, score double, leaf int"), k).select("query_id", "leaf").collect()
        wanted: dict[int, list[int]] = {}
        for query, leaf in true:
            wanted.setdefault(query, []).append(leaf)
        ranks = []
        for vector, own in zip(q, q_ids.tolist()):
            place = {leaf: i for i, leaf in enumerate(tree.walk(vector, len(tree.leaves), self.sizes, 0))}
            ranks.append(np.array([place[leaf] for leaf in wanted.get(own, ())]))
        for visits in range(1, len(tree.leaves) + 1):
            reached = np.mean([(r < visits).mean() for r in ranks if len(r)] or [1.0])
            if reached >= recall:
                return visits, float(reached)
        return len(tree.leaves), 1.0

    def search(self, is_query: Column, k: int = 20, recall: float = 0.95) -> DataFrame:
        """query_id, rank, vec_id, score of the k nearest rows found for each row that `is_query` (over vec_id) picks."""
        kind = "query_id long, vec_id long, score double"
        if self.tree is None:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        visits, self.reached = self.calibrate(is_query, k, recall)
        self.visits = visits
        spark, width, sizes = self.spark, self.width, self.sizes
        tree = spark.sparkContext.broadcast(self.tree)

        def walk(batches) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaves = [tree.value.walk(q, visits, sizes, 3 * k) for q in matrix(b.column(1), width)] if b.num_rows else []
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaves, pa.list_(pa.int32()))], ["query_id", "q", "leaves"])

        queries = self.scratch.write(mapped(self.rows.filter(is_query).select("vec_id", "x"), walk, "query_id long, q array<double>, leaves array<int>"))
        visited = queries.select("query_id", "q", F.explode("leaves").alias("leaf"))
        asked = np.zeros(len(sizes), np.int64)
        for leaf, n in visited.groupBy("leaf").agg(F.count(F.lit(1))).collect():
            asked[leaf] = n
        across = F.array(*[F.lit(int(max(1, -(-n // BLOCK_ROWS)))) for n in sizes])
        down = F.array(*[F.lit(int(max(1, -(-n // BLOCK_QUERIES)))) for n in asked])
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = visited.withColumn("j", F.pmod(F.xxhash64("query_id"), F.get(down, F.col("leaf"))).cast("int")).withColumn("i", every(F.get(across, F.col("leaf"))))
        right = self.rows.withColumn("i", F.pmod(F.xxhash64("vec_id"), F.get(across, F.col("leaf"))).cast("int")).withColumn("j", every(F.get(down, F.col("leaf"))))

        def block(a: pa.Table, b: pa.Table) -> pa.Table:
            found = nearest(matrix(a["q"], width), np.asarray(a["query_id"]), matrix(b["x"], width), np.asarray(b["vec_id"]), k) if a.num_rows and b.num_rows else []
            cols = list(zip(*found)) or [()] * 3
            return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

        found = left.groupBy("leaf", "i", "j").cogroup(right.groupBy("leaf", "i", "j")).applyInArrow(block, kind)
        return _top(found, k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Index(table(spark, sf_dir, "embeddings")).search(F.col("vec_id") % 20 == 0)
