"""Queries on embeddings, with their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embedding as M
from . import corpus
from .registry import cte, query, table, text
from .text_queries import WORDS

FORMULA_WORDS = f"array_to_string(list_transform(regexp_extract_all(statement, {text(r'[*][*]|[a-zA-Z]+|[0-9.]+|[^ ]')}), lambda t: coalesce({WORDS}[t], t)), ' ')"
TERMS = f"w AS (SELECT id, regexp_extract_all(lower({FORMULA_WORDS}), '[a-z0-9_]{{2,}}') AS w FROM theorems), each_ AS (SELECT id, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w)"
TFIDF = """tf AS (SELECT id, term, count(*) AS tf FROM each_ GROUP BY id, term), df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 1000),
 raw_ AS (SELECT id, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM theorems)) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df USING (term))"""


@query("tfidf_embedding", cte(corpus.THEOREMS_SQL, TERMS, TFIDF) + "SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM raw_")
def tfidf_embedding(spark, d):
    return M.tfidf(corpus.theorems(spark, d), "statement").withColumn("weight", F.round("weight", 6))


@query("kmeans_clusters")
def kmeans_clusters(spark, d):
    return M.kmeans(table(spark, d, "embeddings"), "embedding").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))


@query("pca_coordinates")
def pca_coordinates(spark, d):
    t = M.principal_components(table(spark, d, "embeddings"), "embedding")
    return t.select("vec_id", F.round(F.abs(F.col("reduced")[0]), 5).alias("x"), F.round(F.abs(F.col("reduced")[1]), 5).alias("y"))


@query("hybrid_embedding", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / power(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8, 2) + (label * label + 1.0) / power(sqrt(label * label + 1.0) + 1e-8, 2), 5) AS squared, len(embedding) + 2 AS width FROM embeddings")
def hybrid_embedding(spark, d):
    t = table(spark, d, "embeddings")
    both = M.hybrid(F.col("embedding"), F.array(F.col("label").cast("double"), F.lit(1.0)))
    squared = F.aggregate(both, F.lit(0.0), lambda s, x: s + x * x)
    return t.select("vec_id", F.round(squared, 5).alias("squared"), F.size(both).cast("long").alias("width"))
