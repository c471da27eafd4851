"""Spectral layouts against dense eigenvectors, related nodes, and similarities of clusters against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formulake.operators import cluster, graph
from formulake.plans import index_queries, registry


def dense(edges):
    """(nodes, eigenvalues, eigenvectors) of the normalised Laplacian."""
    nodes = sorted({x for a, b, _ in edges if a != b for x in (a, b)})
    at, w = {x: i for i, x in enumerate(nodes)}, np.zeros((len(nodes), len(nodes)))
    for a, b, x in edges:
        if a != b:
            w[at[a], at[b]] += x
            w[at[b], at[a]] += x
    d = w.sum(axis=1)
    return nodes, *np.linalg.eigh(np.eye(len(nodes)) - w / np.sqrt(np.outer(d, d)))


def graphs():
    rng = random.Random(1)
    path = [(i, i + 1, 1.0) for i in range(11)]
    lollipop = [(i, j, 1.0) for i in range(5) for j in range(i)] + [(4, 5, 2.0), (5, 6, 1.0), (6, 6, 9.0), (5, 4, 0.5)]
    return {"path": path, "lollipop": lollipop, "random": [(a, b, rng.uniform(0.5, 2)) for a in range(14) for b in range(a) if rng.random() < 0.4 or a == b + 1]}


@pytest.mark.parametrize("name", ["path", "lollipop", "random"])
def test_spectral(spark, name):
    edges = graphs()[name]
    made, values = graph.spectral(spark.createDataFrame(edges, "src int, dst int, weight double"))
    nodes, known, vectors = dense(edges)
    got = {r["node"]: r["x"] for r in made.collect()}
    assert sorted(got) == nodes and np.allclose(values, known[1:3], atol=1e-8)
    for k in range(2):
        x = np.array([got[n][k] for n in nodes])
        assert np.allclose(np.abs(x @ vectors[:, k + 1]), 1.0, atol=1e-6)  # up to the sign


def test_spectral_steps_broadcast_nothing(spark, monkeypatch):
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    graph.spectral(spark.createDataFrame([(i, (i * 7 + k) % 50, 1.0) for i in range(50) for k in (1, 2, 5)], "src int, dst int, weight double"), steps=4)
    steps = [p for p in plans if "SortMergeJoin" in p]
    assert len(steps) >= 3 and not any("Broadcast" in p for p in plans[-3:])


def test_spectral_of_little(spark):
    assert graph.spectral(spark.createDataFrame([], "src int, dst int, weight double"))[0].collect() == []
    made, values = graph.spectral(spark.createDataFrame([(1, 2, 1.0)], "src int, dst int, weight double"))
    assert np.allclose(values, [2.0]) and len(made.collect()) == 2


def test_few_steps_come_near(spark):
    edges = [(i, (i + 1) % 60, 1.0) for i in range(60)] + [(i, i + 30, 1.0) for i in range(0, 5)]
    _, values = graph.spectral(spark.createDataFrame(edges, "src int, dst int, weight double"), steps=16)
    assert np.allclose(values[0], dense(edges)[1][1], atol=0.02)


def test_spectral_goes_on_until_it_is_exact(spark):
    """Few numbers a node, many restarts, and eigenvectors as near as those of a dense matrix."""
    rng = random.Random(3)
    edges = [(i, 100 + rng.randrange(12), rng.uniform(1, 50)) for i in range(80) for _ in range(4)]
    made, values = graph.spectral(spark.createDataFrame(edges, "src int, dst int, weight double"), steps=8)
    nodes, known, vectors = dense(edges)
    got = {r["node"]: r["x"] for r in made.collect()}
    assert np.allclose(values, known[1:3], atol=1e-8)
    assert all(np.allclose(abs(np.array([got[n][k] for n in nodes]) @ vectors[:, k + 1]), 1.0, atol=1e-8) for k in range(2))


def test_spectral_layout_is_whole(spark):
    """The registered query against dense eigenvectors of all sales."""
    sold = index_queries._sold(spark, "/root/testdata/sf0.001").collect()
    nodes, _, vectors = dense([tuple(r) for r in sold])
    got = {r["node"]: (r["x"], r["y"]) for r in registry.QUERIES["spectral_layout"](spark, "/root/testdata/sf0.001").collect()}
    assert sorted(got) == nodes
    assert all(abs(abs(vectors[i, k + 1]) - got[n][k]) < 1.5e-4 for i, n in enumerate(nodes) for k in range(2))


def test_springs(spark):
    """Two cliques with one edge between: neighbours come near, the cliques come apart, no two nodes coincide, and the layout is the same again."""
    edges = [(a + c, b + c, 1.0) for c in (0, 10) for a in range(6) for b in range(a)] + [(0, 10, 0.2), (3, 3, 5.0)]
    nodes = spark.createDataFrame([(i,) for i in (*range(6), *range(10, 16), 99)], "node int")
    df = spark.createDataFrame(edges, "src int, dst int, weight double")
    made = [{r["node"]: np.array([r["x"], r["y"]]) for r in graph.springs(nodes, df, 12).collect()} for _ in range(2)]
    at = made[0]
    assert sorted(at) == [*range(6), *range(10, 16), 99] and all(np.isfinite(p).all() for p in at.values())
    far = lambda pairs: np.mean([np.linalg.norm(at[a] - at[b]) for a, b in pairs])
    within = [(a, b) for a, b, _ in edges if a != b and (a < 10) == (b < 10)]
    across = [(a, b) for a in range(1, 6) for b in range(11, 16)]
    assert far(across) > 1.5 * far(within) and min(np.linalg.norm(at[a] - at[b]) for a, b in within) > 1e-4
    assert all(np.allclose(made[1][n], p, atol=1e-6) for n, p in at.items())


def test_related(spark):
    rng = random.Random(2)
    edges = [(rng.choice([0, 0, 1, rng.randint(2, 60)]), rng.randint(0, 60), rng.choice([0.5, 1.0, 2.0])) for _ in range(600)]
    total = {}
    for a, b, w in edges:
        if a != b:
            total[a, b] = total[b, a] = total.get((a, b), 0.0) + w
    expected = set()
    for node in {a for a, _ in total}:
        best = sorted((-w, b) for (a, b), w in total.items() if a == node)[:4]
        expected |= {(node, i + 1, b, -w) for i, (w, b) in enumerate(best)}
    df = graph.related(spark.createDataFrame(edges, "src int, dst int, weight double"), 4, shards=3)
    assert {tuple(r) for r in df.collect()} == expected
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4  # before and after each shuffle


def test_similarities_without_all_pairs(spark):
    """Against the similarity of every pair, with empty sets, equal rows, zeros."""
    rng = random.Random(6)
    some = lambda k: sorted(rng.sample("abcdefgh", rng.randint(0, k)))
    rows = [(i, rng.choice("xyz"), some(3), some(2), some(1), rng.choice([0, 0, 1, 2, 3.5, 7])) for i in range(60)]
    rows += [(100 + i, *r[1:]) for i, r in enumerate(rows[:15])]
    prints = spark.createDataFrame([(i, h, s, o, f, float(c)) for i, h, s, o, f, c in rows], "id int, hash string, symbols array<string>, operations array<string>, functions array<string>, complexity double")
    groups = {}
    for r in rows:
        groups.setdefault(repr(r[1:]), []).append(r[0])
    of = {i: min(own) for own in groups.values() for i in own}
    members = spark.createDataFrame([(i, c, len([j for j in of if of[j] == c])) for i, c in of.items()], "id int, class int, n long")
    clusters = spark.createDataFrame([(c, c % 3) for c in set(of.values())], "class int, cluster int")
    df = cluster.confidence_and_center(prints, members, clusters)
    got = {r["cluster"]: (r["confidence"], r["center"]) for r in df.collect()}

    def alike(a, b):
        jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if set(x) | set(y) else 0.0
        most = max(a[5], b[5])
        return 0.3 * (a[1] == b[1]) + 0.25 * jaccard(a[2], b[2]) + 0.25 * jaccard(a[3], b[3]) + 0.1 * jaccard(a[4], b[4]) + 0.1 * (1 - abs(a[5] - b[5]) / most if most else 1.0)

    for c in range(3):
        own = [r for r in rows if of[r[0]] % 3 == c]
        sums = {a[0]: sum(alike(a, b) for b in own if b[0] != a[0]) for a in own}
        assert abs(got[c][0] - sum(sums.values()) / (len(own) * (len(own) - 1))) < 1e-9
        assert got[c][1] == min((of[i] for i in sums), key=lambda i: (-round(sums[i], 9), i))
    one = cluster.confidence_and_center(prints.filter("id = 1"), spark.createDataFrame([(1, 1, 1)], "id int, class int, n long"), spark.createDataFrame([(1, 0)], "class int, cluster int"))
    assert [r["confidence"] for r in one.select(F.col("confidence")).collect()] == [1.0]
