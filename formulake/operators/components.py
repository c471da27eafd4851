"""Connected components of an undirected graph (survey G1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

MAX_ROUNDS = 60


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """One star operation over pairs (u, v), each once, u > v."""
    if small:  # neighbours below u
        near = pairs
    else:
        near = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = near.join(least, "u")
    if small:
        out = out.select(F.col("v").alias("u"), "m").unionByName(least.select("u", "m"))
    else:
        out = out.filter("v > u").select(F.col("v").alias("u"), "m")
    return out.filter("u <> m").select("u", F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each node of ``edges``; ``component`` is its class's smallest node.

    Alternates large-star and small-star until nothing changes. ``cut`` writes
    a round's pairs at once and cuts their lineage, by a reliable checkpoint. Loops give no pair but keep
    their node; null ends are dropped; an empty graph gives no rows. Nothing is
    gathered in one task: minima combine before the shuffle.
    """
    clean = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    pairs = clean.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def marked(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The cut table, with its rows' number and sum of hashes, taken while it is written."""
        seen = Observation()
        out = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        return out, tuple(seen.get.values())

    pairs, before = marked(pairs)
    for _ in range(MAX_ROUNDS):
        pairs, now = marked(_star(_star(pairs, False), True))
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    labels = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = clean.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
