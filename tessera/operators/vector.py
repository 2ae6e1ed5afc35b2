"""Nearest neighbours: exact, filtered, past tombstones, and approximate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine, squared_distance


#: Queries that one pass over the vectors holds.
BLOCK_QUERIES = 8192


def _doubles(name: str) -> Column:
    return F.col(name).cast("array<double>")


def top_k(scored: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of one query: partial top-k in each task, then one merge; `rank` counts from 1."""
    best = scored.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def knn_l2(vectors: DataFrame, query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", squared: bool = True) -> DataFrame:
    """id, distance, score = 1 / (1 + distance), rank; vectors of another length take no part."""
    d = squared_distance(_doubles(vector_col), query)
    kept = vectors.filter(F.size(vector_col) == F.size(query))
    scored = kept.select(F.col(id_col), (d if squared else F.sqrt(d)).alias("distance")).withColumn("score", 1 / (1 + F.col("distance")))
    return top_k(scored, k, [F.round("distance", 9).asc(), F.col(id_col)])


def knn_cosine(vectors: DataFrame, query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", where: Column | None = None, at_least: float | None = None) -> DataFrame:
    """id, score, rank by cosine, over the rows that `where` keeps and above the threshold."""
    kept = vectors.filter(F.size(vector_col) == F.size(query))
    kept = kept.filter(where) if where is not None else kept
    scored = kept.select(F.col(id_col), cosine(_doubles(vector_col), query).alias("score"))
    scored = scored.filter(F.col("score") >= at_least) if at_least is not None else scored
    return top_k(scored, k, [F.round("score", 9).desc(), F.col(id_col)])


def knn_live(vectors: DataFrame, dead: DataFrame, query: Column, k: int, overfetch: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """k-NN past tombstones: exact over live rows, or, with `overfetch`, the live ones of the best k * overfetch."""
    if not overfetch:
        return knn_l2(vectors.join(dead.select(id_col), id_col, "left_anti"), query, k, id_col, vector_col)
    near = knn_l2(vectors, query, k * overfetch, id_col, vector_col).drop("rank")
    return top_k(near.join(dead.select(id_col), id_col, "left_anti"), k, [F.round("distance", 9).asc(), F.col(id_col)])


def knn_by_queries(vectors: DataFrame, queries: DataFrame, k: int, dim: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, score, rank by cosine for a table of queries (query_id, q), in blocks of vectors and queries.

    Blocks of BLOCK_QUERIES queries go through all vectors in turn: queries are dealt to numbered blocks, and each pass
    holds one of them. Only a task's k best per query leave it.
    """
    import numpy as np
    import pyarrow as pa

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    kept = vectors.filter(F.size(vector_col) == dim).select(id_col, _doubles(vector_col))
    n = queries.count()
    blocks = max(1, -(-n // (BLOCK_QUERIES // 2)))  # about half full, so that hashing overfills none
    sc, parts = vectors.sparkSession.sparkContext, []
    for block in range(blocks):
        own_queries = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows_ = own_queries.collect()
        given = sc.broadcast((np.array([r["query_id"] for r in rows_]), np.array([r["q"] for r in rows_], float).reshape(-1, dim)))

        def run(batches, given=given):
            ids, q = given.value
            qn = np.linalg.norm(q, axis=1)
            for b in batches:
                x = np.asarray(b.column(1).flatten(), float).reshape(-1, dim)
                own = np.asarray(b.column(0))
                both = qn[:, None] * np.linalg.norm(x, axis=1)[None]
                s = np.divide(q @ x.T, both, out=np.zeros_like(both), where=both > 0)
                rank = -np.round(s, 9)
                m = min(k, len(own))
                row, column = [], []
                if len(own) and len(ids):
                    edge = np.partition(rank, m - 1, axis=1)[:, m - 1]
                    for i in range(len(ids)):  # all that tie with the last one compete by id
                        at = np.flatnonzero(rank[i] <= edge[i])
                        at = at[np.lexsort((own[at], rank[i][at]))[:m]]
                        row.append(np.full(len(at), i))
                        column.append(at)
                row, column = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (row, column))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row] if len(ids) else [], pa.int64()), b.column(0).take(pa.array(column)), pa.array(s[row, column], pa.float64())], ["query_id", id_col, "score"])

        parts.append(kept.mapInArrow(run, f"query_id long, {id_col} {kinds[id_col]}, score double"))
    near = reduce(DataFrame.union, parts)
    order = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), id_col)
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lsh_neighbours(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", bucket: float = 0.5, tables: int = 8) -> DataFrame:
    """Approximate L2 neighbours through bucketed random projections."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    data = vectors.select(id_col, array_to_vector(_doubles(vector_col)).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=42).fit(data)
    found = model.approxNearestNeighbors(data, Vectors.dense(query), k)
    return found.select(id_col, (F.col("distCol") * F.col("distCol")).alias("distance"))
