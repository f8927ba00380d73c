"""Vectors: cosine pairs, nearest neighbours, components, one-to-one matches, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions.similarity import rounded
from echofold.operators import candidates, grouping
from echofold.operators.graph import communities, components, written
from echofold.queries.views import table

THRESHOLD = 0.36  # at the default of 0.80 these vectors have no pair


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def semantic_pairs_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.cosine_pairs(vectors(spark, sf_dir), THRESHOLD).select("l", "r", rounded(F.col("similarity")).alias("similarity"))


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, among all."""
    v = vectors(spark, sf_dir)
    near = candidates.knn(v, v.filter(F.col("id") % 50 == 0), 10)
    return near.select("query", "neighbour", rounded(F.col("similarity")).alias("similarity"), "rank")


def semantic_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, label) over the cosine pairs; the label is the least node."""
    return components(candidates.cosine_pairs(vectors(spark, sf_dir), THRESHOLD).selectExpr("l AS a", "r AS b"))


def greedy_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best pairs, every vector in one at most, cut at the operator's cap."""
    v = vectors(spark, sf_dir)
    n = v.count()
    pairs = candidates.cosine_pairs(v, THRESHOLD).selectExpr("l AS a", "r AS b", "similarity")
    return grouping.one_to_one(pairs, limit=min(200, max(20, n // 25)))


def vector_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity communities of the cosine graph."""
    pairs = written(candidates.cosine_pairs(vectors(spark, sf_dir), THRESHOLD), "pairs")
    edges = pairs.select(F.col("l").cast("string").alias("a"), F.col("r").cast("string").alias("b"), F.col("similarity").alias("weight"))
    return communities(edges, THRESHOLD)


QUERIES = {f.__name__: f for f in (semantic_pairs_cosine, knn_topk, semantic_components, greedy_one_to_one, vector_communities)}
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
PAIRS = f"pairs AS (SELECT a.vec_id AS l, b.vec_id AS r, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= {THRESHOLD})"
SQL = {
    "semantic_pairs_cosine": f"WITH {PAIRS} SELECT l, r, round(round(s, 6), 4) AS similarity FROM pairs",
    "knn_topk": f"""WITH s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round({_COS}, 6) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS INTEGER) AS rank FROM s) SELECT query, neighbour, round(s, 4) AS similarity, rank FROM k WHERE rank <= 10""",
    "semantic_components": f"""WITH RECURSIVE {PAIRS}, edges AS (SELECT l AS u, r AS v FROM pairs UNION SELECT r, l FROM pairs),
        reach AS (SELECT DISTINCT u AS node, u AS label FROM edges UNION SELECT e.v, reach.label FROM reach JOIN edges e ON e.u = reach.node)
        SELECT node, min(label) AS label FROM reach GROUP BY node""",
}
