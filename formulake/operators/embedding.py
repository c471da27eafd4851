"""Embeddings: TF-IDF as sparse rows, hybrids, k-means, principal components (survey E9, E10, G8, G9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import latex


def terms(text: Column) -> Column:
    """Words of two characters or more and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0))
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)


#: Rows whose terms a task counts, about.
PART_ROWS = 50_000


def tfidf(rows: DataFrame, formula: str = "formula", id_col: str = "id", most: int = 1000) -> DataFrame:
    """(id, term, weight): rows of length 1, over the ``most`` most frequent terms (ties in order of the alphabet).

    The limit on terms is part of the embedding. IDF is ln((1 + n) / (1 + df)) + 1.
    """
    n = rows.count()
    # Dealt by id before terms are made, in as many parts as the rows need: however few files they come from, no task counts more than a part.
    dealt = rows.select(F.col(id_col).alias("id"), F.col(formula).alias("__f")).repartition(max(1, -(-n // PART_ROWS)), "id")
    each = dealt.select("id", F.explode(terms(latex.formula_words(F.col("__f")))).alias("term"))
    tf = each.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    chosen = df.orderBy(F.desc("total"), "term").limit(most).select("term", (F.log((1.0 + F.lit(float(n))) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    raw = tf.join(F.broadcast(chosen), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))  # at most `most` rows
    length = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return raw.join(length.hint("merge"), "id").select("id", "term", (F.col("w") / F.col("l")).alias("weight"))


def unit(v: Column, epsilon: float = 1e-8) -> Column:
    """A vector over its length."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + epsilon
    return F.transform(v, lambda x: x.cast("double") / length)


def hybrid(a: Column, b: Column) -> Column:
    """Two embeddings, each of unit length, one after the other."""
    return F.concat(unit(a), unit(b))


def _vectors(rows: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))


def kmeans(rows: DataFrame, vector: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``rows`` with ``cluster``."""
    from pyspark.ml.clustering import KMeans

    made = _vectors(rows, vector)
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(made).transform(made).drop("__v")


def principal_components(rows: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """``rows`` with ``reduced``, the first ``k`` components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    made = _vectors(rows, vector)
    return PCA(k=k, inputCol="__v", outputCol="__r").fit(made).transform(made).withColumn("reduced", vector_to_array("__r")).drop("__v", "__r")
