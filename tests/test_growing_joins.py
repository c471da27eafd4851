"""Joins of tables that grow: the planner's estimates leave out explode and compression, so these may not be broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from formulake.operators import cluster, embedding, expressions, graph, radius


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.mark.parametrize("places", [2, 12])
def test_vectors_meet_by_a_shuffle(spark, tmp_path, places):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(places)]) for i in range(300)]
    spark.createDataFrame(rows, "id int, v array<double>").write.parquet(f"{tmp_path}/rows")
    links, members = radius.vector_links(spark.read.parquet(f"{tmp_path}/rows"), "v", 0.5)
    assert broadcasts(links) == broadcasts(members) == 0


def test_springs_join_by_a_shuffle(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "cut", lambda df: seen.append(broadcasts(df)) or df.checkpoint())
    nodes = spark.range(40).select(F.col("id").alias("node"))
    edges = spark.range(40).select(F.col("id").alias("src"), ((F.col("id") * 7) % 40).alias("dst"), F.lit(1.0).alias("weight"))
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints/test-growing-joins")
    graph.springs(nodes, edges, 2)
    assert len(seen) == 4 and not any(seen)


def test_terms_are_counted_in_parts(spark, tmp_path, monkeypatch):
    """However few files the rows come from, the tasks that count terms grow with the rows; a row's weights have length 1."""
    monkeypatch.setattr(embedding, "PART_ROWS", 100, raising=False)
    spark.range(1000).select("id", F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(" + sin(y)")).alias("formula")).coalesce(1).write.parquet(f"{tmp_path}/rows")
    made = embedding.tfidf(spark.read.parquet(f"{tmp_path}/rows"), "formula", most=5)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and ", 10), REPARTITION_BY_NUM" in plan and plan.count("BroadcastExchange") <= 2  # the chosen terms
    assert {round(r["l"], 9) for r in made.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("l")).collect()} == {1.0}


def test_results_meet_rows_in_parts(spark, tmp_path, monkeypatch):
    """Rows of one file are dealt into parts before they get their results; few results are sent and many are joined, with the same rows."""
    spark.range(1000).select("id", F.concat(F.lit("x + "), (F.col("id") % 5).cast("string")).alias("formula")).coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    monkeypatch.setattr(expressions, "PART_ROWS", 100, raising=False)
    made = []
    for most in (1000, 2):
        monkeypatch.setattr(expressions, "BROADCAST_ROWS", most, raising=False)
        df = expressions.hypotheses(rows)
        assert ", 10), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString() and broadcasts(df) == (most == 1000)
        made.append(sorted(map(str, df.collect())))
    assert made[0] == made[1] and len({r["id"] for r in df.select("id").collect()}) == 1000


def test_fingerprints_meet_by_a_shuffle(spark, tmp_path):
    """Rows, classes and clusters of small files; before, the planner sent all rows with their fingerprints to the driver."""
    rows = spark.range(2000).selectExpr("id", "concat('h', id % 7) AS hash", "array('x', concat('y', id % 50)) AS symbols", "array('Add') AS operations", "array() AS functions", "id % 3 AS complexity")
    rows.withColumn("functions", F.col("functions").cast("array<string>")).write.parquet(f"{tmp_path}/prints")
    prints = spark.read.parquet(f"{tmp_path}/prints")
    links, members = cluster.similar_fingerprints(prints, 0.7)
    assert broadcasts(members) == 0 and members.count() == 2000
    members.write.parquet(f"{tmp_path}/members")
    members = spark.read.parquet(f"{tmp_path}/members")
    members.select("class", (F.col("class") % 4).alias("cluster")).distinct().write.parquet(f"{tmp_path}/clusters")
    clusters = spark.read.parquet(f"{tmp_path}/clusters")
    out = cluster.confidence_and_center(prints, members, clusters)
    assert broadcasts(out) == 0
    classes = cluster.fingerprint_classes(prints)
    assert classes.filter("class >= 1050").count() == 0 and classes.agg(F.sum("n")).first()[0] == 2000
    few = cluster.confidence_and_center(classes.select(F.col("class").alias("id"), "f.*"), classes, clusters)
    found = [{r["cluster"]: (round(r["confidence"], 9), r["center"]) for r in df.collect()} for df in (out, few)]
    assert found[0] == found[1] and len(found[0]) == 4
