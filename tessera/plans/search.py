"""Queries of keyword search, vector search and fusion."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, keywords, search_tokens
from ..operators import fusion, keyword, vector
from . import sql


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _index(spark, sf):
    """The saved index of the documents, in the shared folder or the warehouse."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return keyword.kept(_read(spark, sf, "documents"), "doc_id", "text", f"{root}/tessera-index")


def _queries(spark, sf):
    return _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_tokens(spark, sf):
    tokens = search_tokens(F.col("text"))
    return _read(spark, sf, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_terms"), F.array_join(tokens, " ").alias("tokens"))


def bm25_stats(spark, sf):
    return _index(spark, sf).stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def bm25_idf(spark, sf):
    return _index(spark, sf).idf.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf):
    found = keyword.search(_index(spark, sf), _queries(spark, sf).filter("query_id = 0"), 10)
    return found.select("id", F.round("score", 6).alias("score"), "rank")


def bm25_multi_query(spark, sf):
    return keyword.search(_index(spark, sf), _queries(spark, sf), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _vectors(spark, sf):
    return _read(spark, sf, "embeddings")


def _query_vector(spark, sf, vec_id: int = 0):
    row = _vectors(spark, sf).filter(F.col("vec_id") == vec_id).select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in row[0]])


def knn_l2_topk(spark, sf):
    return vector.knn_l2(_vectors(spark, sf), _query_vector(spark, sf), 10).select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank")


def knn_l2_plain(spark, sf):
    return vector.knn_l2(_vectors(spark, sf), _query_vector(spark, sf), 10, squared=False).select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank")


def knn_cosine_topk(spark, sf):
    return vector.knn_cosine(_vectors(spark, sf), _query_vector(spark, sf), 10).select("vec_id", F.round("score", 6).alias("score"), "rank")


def knn_by_vector(spark, sf):
    """Every tenth vector as a query against all."""
    queries = _vectors(spark, sf).filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    return vector.knn_by_queries(_vectors(spark, sf), queries, 5, 64).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def knn_filtered(spark, sf):
    found = vector.knn_cosine(_vectors(spark, sf), _query_vector(spark, sf), 5, where=F.col("label").isin(1, 3, 5), at_least=-0.2)
    return found.select("vec_id", F.round("score", 6).alias("score"), "rank")


def _dead(spark, sf):
    return _vectors(spark, sf).filter("label in (2, 4)").select("vec_id")


def knn_live(spark, sf):
    return vector.knn_live(_vectors(spark, sf), _dead(spark, sf), _query_vector(spark, sf), 10).select("vec_id", F.round("distance", 6).alias("distance"), "rank")


def knn_overfetch(spark, sf):
    return vector.knn_live(_vectors(spark, sf), _dead(spark, sf), _query_vector(spark, sf), 10, overfetch=3).select("vec_id", F.round("distance", 6).alias("distance"), "rank")


def knn_lsh_recall(spark, sf):
    """Share of the ten nearest that bucketed random projections find for one query."""
    vectors = _vectors(spark, sf)
    q = [float(x) for x in vectors.filter("vec_id = 0").first()["embedding"]]
    found = vector.lsh_neighbours(vectors, q, 10).select("vec_id")
    true = vector.knn_l2(vectors, _query_vector(spark, sf), 10).select("vec_id")
    return true.join(found.withColumn("hit", F.lit(1)), "vec_id", "left").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def _lists(spark, sf, k):
    """Each benchmark item's keyword list, and a vector list of the same length: vector i for item i."""
    bm25 = keyword.search(_index(spark, sf), _queries(spark, sf), k).select("query_id", "id", "rank")
    queries = _vectors(spark, sf).join(_queries(spark, sf).select("query_id"), F.col("vec_id") == F.col("query_id"), "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    near = vector.knn_by_queries(_vectors(spark, sf), queries, k, 64).select("query_id", F.col("vec_id").alias("id"), "rank")
    return near, bm25


def rrf_fusion(spark, sf):
    near, bm25 = _lists(spark, sf, 20)
    fused = fusion.reciprocal_rank([(near, 0.7), (bm25, 0.3)], keys=["query_id"])
    return fused.select("query_id", "id", F.round("score", 9).alias("score"))


def hybrid_search(spark, sf):
    near, bm25 = _lists(spark, sf, 20)
    fused = fusion.ranked(fusion.reciprocal_rank([(near, 0.7), (bm25, 0.3)], keys=["query_id"]), 10, ["query_id"])
    texts = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 200).alias("preview"))
    return fused.join(texts, "id", "left").select("query_id", "id", F.round("score", 9).alias("score"), "rank", "preview")


def _found(spark, sf):
    return keyword.search(_index(spark, sf), _queries(spark, sf), 10).withColumn("score", F.round(F.col("score") / 100, 6))


def needs_fallback(spark, sf):
    return fusion.needs_fallback(_found(spark, sf), ["query_id"])


def merge_fallback(spark, sf):
    """Local: keyword hits by source; cloud: the labelled documents of the same sources."""
    docs = _read(spark, sf, "documents")
    local = docs.select(F.lit(0).alias("q"), F.col("source").alias("path"), F.round(F.col("n_chars") / 40000, 6).alias("score"), F.col("doc_id").alias("pos"), F.lit(None).cast("string").alias("source")).filter("pos % 2 = 0")
    cloud = docs.select(F.lit(0).alias("q"), F.concat("source", F.lit("/"), "lang").alias("path"), F.round(F.col("n_chars") / 30000, 6).alias("score"), F.col("doc_id").alias("pos"), F.lit("cloud").alias("source")).filter("pos % 2 = 1")
    cloud = cloud.unionByName(local.withColumn("source", F.lit("cloud")).withColumn("score", F.col("score") * 2))
    return fusion.merge(local, cloud, 25, "local", ["q"]).select("path", F.round("score", 6).alias("score"), "source", "rank")


def helix_fusion(spark, sf):
    """Memories: events by distance, those of errors shared; documents: their keyword score."""
    memory = _read(spark, sf, "events").select(F.concat(F.lit("m"), "event_id").alias("id"), fusion.memory_score(F.col("value") - 5, F.col("event_type") == "error").alias("score"))
    docs = _found(spark, sf).filter("query_id = 0").select(F.concat(F.lit("d"), "id").alias("id"), "score")
    both = memory.unionByName(docs)
    return vector.top_k(both.withColumn("score", F.round("score", 6)), 20, [F.desc("score"), F.col("id")]).select("id", "score", "rank")


def category_boost(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", F.col("source").alias("category"), (F.col("n_chars") / 1000).alias("score"))
    weights = spark.createDataFrame([(f"src{i}", 0.5 + i / 20) for i in range(10)], "category string, weight double")
    boosts = spark.createDataFrame([("first", f"src{i}", 1 + i / 10) for i in range(0, 20, 2)], "agent string, category string, boost double")
    return fusion.boosted(docs, weights, boosts, "First").select("doc_id", "weight", "boost", F.round("boosted", 6).alias("boosted"))


def capability_search(spark, sf):
    """Names and descriptions of parts and of documents, by words of a question."""
    part = _read(spark, sf, "part").select(F.lit(0).alias("kind"), F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    docs = _read(spark, sf, "documents").select(F.lit(1).alias("kind"), F.col("doc_id").alias("pos"), F.concat_ws(" ", "source", "text").alias("text"))
    found = part.unionByName(docs).select("kind", "pos", fusion.word_overlap(F.col("text"), "The green STEEL the th er large").alias("score")).filter("score > 0")
    return vector.top_k(found, 50, [F.desc("score"), F.col("kind"), F.col("pos")])


def context_render(spark, sf):
    docs = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), "text")
    found = keyword.search(_index(spark, sf), _queries(spark, sf), 5).join(docs, "id")
    out = fusion.context(found, n=500, keys=["query_id"])
    return out.select("query_id", F.length("context").alias("n_chars"), content_hash(F.col("context")).alias("sha256"))


def text_keywords(spark, sf):
    """The five most frequent words of each source's documents, ties by first occurrence."""
    from pyspark.sql import Window as W

    words = _read(spark, sf, "documents").select("source", "doc_id", F.posexplode(keywords(F.col("text"))).alias("pos", "word"))
    counts = words.groupBy("source", "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    order = W.partitionBy("source").orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select("source", "word", "n", "rank")


def jaccard_overlap(spark, sf):
    """Of the words of each document and of the next one."""
    docs = _read(spark, sf, "documents").select("doc_id", F.array_distinct(keywords(F.col("text"))).alias("words"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("words").alias("after"))
    return docs.join(after, "doc_id").select("doc_id", F.round(fusion.jaccard(F.col("words"), F.col("after")), 9).alias("overlap"))


def rerank_hook(spark, sf):
    """Keyword hits scored anew by a pandas UDF (a stand-in for a model): shorter texts first."""


    @F.pandas_udf("double")
    def model(text: pd.Series) -> pd.Series:
        return 1.0 / (1.0 + text.str.len())

    docs = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    found = keyword.search(_index(spark, sf), _queries(spark, sf), 10).join(docs, "id")
    return fusion.rerank(found, model("text"), 3, ["query_id"]).select("query_id", "id", F.round("rerank_score", 9).alias("rerank_score"), F.round("pre_rerank_score", 6).alias("pre_rerank_score"), "rank")


QUERIES = {f.__name__: f for f in (bm25_tokens, bm25_stats, bm25_idf, bm25_topk, bm25_multi_query, knn_l2_topk, knn_l2_plain, knn_cosine_topk, knn_by_vector, knn_filtered, knn_live, knn_overfetch, knn_lsh_recall, rrf_fusion, hybrid_search, needs_fallback, merge_fallback, helix_fusion, category_boost, capability_search, context_render, text_keywords, jaccard_overlap, rerank_hook)}

_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_NEAR = f"near AS (SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({sql.COSINE}, 9) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)) WHERE rank <= 20)"
_FUSED = f"{_NEAR}, parts AS (SELECT query_id, id, 0 AS list, rank, 0.7 / (60 + rank) AS part FROM near UNION ALL SELECT query_id, id, 1, rank, 0.3 / (60 + rank) FROM bm25), fused AS (SELECT query_id, id, sum(part) AS score, min((list, rank)) AS first FROM parts GROUP BY 1, 2)"

ORACLE = {
    "bm25_tokens": f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_terms, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {sql.tokens('text')} AS t FROM documents)",
    "bm25_stats": f"WITH {sql.bm25(10)} SELECT n_docs, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_idf": f"WITH {sql.bm25(10)} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {sql.bm25(10)} SELECT id, round(score, 6) AS score, rank::INT AS rank FROM bm25 WHERE query_id = 0",
    "bm25_multi_query": f"WITH {sql.bm25(10)} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM bm25",
    "knn_l2_topk": f"SELECT e.vec_id, round({sql.SQUARED}, 6) AS distance, round(1 / (1 + {sql.SQUARED}), 6) AS score, row_number() OVER (ORDER BY round({sql.SQUARED}, 9), e.vec_id)::INT AS rank FROM embeddings e, {_Q0} ORDER BY rank LIMIT 10",
    "knn_l2_plain": f"SELECT e.vec_id, round(sqrt({sql.SQUARED}), 6) AS distance, round(1 / (1 + sqrt({sql.SQUARED})), 6) AS score, row_number() OVER (ORDER BY round(sqrt({sql.SQUARED}), 9), e.vec_id)::INT AS rank FROM embeddings e, {_Q0} ORDER BY rank LIMIT 10",
    "knn_cosine_topk": f"SELECT e.vec_id, round({sql.COSINE}, 6) AS score, row_number() OVER (ORDER BY round({sql.COSINE}, 9) DESC, e.vec_id)::INT AS rank FROM embeddings e, {_Q0} ORDER BY rank LIMIT 10",
    "knn_by_vector": f"SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, round({sql.COSINE}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({sql.COSINE}, 9) DESC, e.vec_id)::INT AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 10 = 0) WHERE rank <= 5",
    "knn_filtered": f"SELECT * FROM (SELECT e.vec_id, round({sql.COSINE}, 6) AS score, row_number() OVER (ORDER BY round({sql.COSINE}, 9) DESC, e.vec_id)::INT AS rank FROM embeddings e, {_Q0} WHERE label IN (1, 3, 5) AND {sql.COSINE} >= -0.2) WHERE rank <= 5",
    "knn_live": f"SELECT e.vec_id, round({sql.SQUARED}, 6) AS distance, row_number() OVER (ORDER BY round({sql.SQUARED}, 9), e.vec_id)::INT AS rank FROM embeddings e, {_Q0} WHERE label NOT IN (2, 4) ORDER BY rank LIMIT 10",
    "knn_overfetch": f"WITH near AS (SELECT e.vec_id, label, {sql.SQUARED} AS d FROM embeddings e, {_Q0} ORDER BY round(d, 9), e.vec_id LIMIT 30) SELECT vec_id, round(d, 6) AS distance, row_number() OVER (ORDER BY round(d, 9), vec_id)::INT AS rank FROM near WHERE label NOT IN (2, 4) ORDER BY rank LIMIT 10",
    "rrf_fusion": f"WITH {sql.bm25(20)}, {_FUSED} SELECT query_id, id, round(score, 9) AS score FROM fused",
    "hybrid_search": f"WITH {sql.bm25(20)}, {_FUSED}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, id)::INT AS rank FROM fused) SELECT query_id, id, round(score, 9) AS score, rank, substr(text, 1, 200) AS preview FROM top LEFT JOIN documents ON id = doc_id WHERE rank <= 10",
    "needs_fallback": f"WITH {sql.bm25(10)} SELECT query_id, count(*) < 3 OR min_by(round(score / 100, 6), rank) < 0.45 AS fallback FROM bm25 GROUP BY 1",
    "merge_fallback": """WITH local AS (SELECT source AS path, round(n_chars / 40000, 6) AS score, doc_id AS pos, NULL AS source, 0 AS list FROM documents WHERE doc_id % 2 = 0),
cloud AS (SELECT source || '/' || lang AS path, round(n_chars / 30000, 6) AS score, doc_id AS pos, 'cloud' AS source, 1 AS list FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT path, score * 2, pos, 'cloud', 1 FROM local),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY list, pos) AS n FROM (SELECT * FROM local UNION ALL SELECT * FROM cloud)) WHERE n = 1)
SELECT * FROM (SELECT path, round(score, 6) AS score, coalesce(source, 'local') AS source, row_number() OVER (ORDER BY score DESC, list, pos)::INT AS rank FROM once) WHERE rank <= 25""",
    "helix_fusion": f"""WITH {sql.bm25(10)}, united AS (SELECT 'm' || event_id AS id, round((CASE WHEN value - 5 >= 0 THEN 1 / (1 + (value - 5)) ELSE 0.5 END) * (CASE WHEN event_type = 'error' THEN 8 ELSE 12 END), 6) AS score FROM events UNION ALL SELECT 'd' || id, round(score / 100, 6) FROM bm25 WHERE query_id = 0)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM united ORDER BY rank LIMIT 20""",
    "category_boost": "SELECT doc_id, w AS weight, b AS boost, round(n_chars / 1000 * w * b, 6) AS boosted FROM (SELECT *, CASE WHEN i < 10 THEN 0.5::DOUBLE + i / 20 ELSE 0.5 END AS w, CASE WHEN i % 2 = 0 THEN 1::DOUBLE + i / 10 ELSE 1.0 END AS b FROM (SELECT *, substr(source, 4)::INT AS i FROM documents))",
    "capability_search": "WITH t AS (SELECT 0 AS kind, p_partkey AS pos, p_name || ' ' || p_type AS text FROM part UNION ALL SELECT 1, doc_id, source || ' ' || text FROM documents), s AS (SELECT kind, pos, "
    + " + ".join(f"contains(lower(text), '{w}')::INT" for w in ("the", "green", "steel", "th", "er", "large"))
    + " AS score FROM t) SELECT kind, pos, score, row_number() OVER (ORDER BY score DESC, kind, pos)::INT AS rank FROM s WHERE score > 0 ORDER BY rank LIMIT 50",
    "context_render": f"WITH {sql.bm25(5)}, c AS (SELECT query_id, string_agg('[' || source || ']' || chr(10) || substr(text, 1, 500), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM bm25 JOIN documents ON id = doc_id GROUP BY 1) SELECT query_id, length(context)::INT AS n_chars, sha256(context) AS sha256 FROM c",
    "text_keywords": f"WITH w AS (SELECT source, doc_id, unnest(k) AS word, generate_subscripts(k, 1) AS pos FROM (SELECT source, doc_id, {sql.keywords('text')} AS k FROM documents)), c AS (SELECT source, word, count(*) AS n, min((doc_id, pos)) AS first FROM w GROUP BY 1, 2) SELECT source, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first)::INT AS rank FROM c) WHERE rank <= 5",
    "jaccard_overlap": f"WITH d AS (SELECT doc_id, list_distinct({sql.keywords('text')}) AS w FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) ELSE 0 END, 9) AS overlap FROM d a JOIN d b ON b.doc_id = a.doc_id + 1",
    "rerank_hook": f"WITH {sql.bm25(10)}, r AS (SELECT query_id, id, 1 / (1.0::DOUBLE + length(text)) AS rerank, score, rank AS old FROM bm25 JOIN documents ON id = doc_id) SELECT * FROM (SELECT query_id, id, round(rerank, 9) AS rerank_score, round(score, 6) AS pre_rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, old)::INT AS rank FROM r) WHERE rank <= 3",
}
