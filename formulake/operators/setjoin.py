"""Similarity joins on token sets: an equi-join on tokens instead of all pairs (survey J1, J2, J9, J10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sets


def prefixes(rows: DataFrame, tokens: str, threshold: float, id_col: str = "id") -> DataFrame:
    """(id, n, p, token): the rarest tokens of each set that another one with a Jaccard similarity of ``threshold`` must share one of; the set's size and the token's place by rarity."""
    own = rows.select(F.col(id_col).alias("id"), F.array_distinct(tokens).alias("set"))
    each = own.select("id", F.explode("set").alias("token"))
    rare = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(rare, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("by"))
    keep = F.greatest(F.size("by") - F.ceil(F.size("by") * F.lit(threshold) - 1e-9) + 1, F.lit(1)).cast("int")
    return ordered.select("id", F.size("by").alias("n"), F.posexplode(F.slice(F.transform("by", lambda x: x["token"]), F.lit(1), keep)).alias("p", "token"))


def may_reach(threshold: float, n: Column, p: Column, m: Column, q: Column) -> Column:
    """Whether sets of sizes ``n`` and ``m`` whose first shared token is at places ``p`` and ``q`` can have the similarity: by their sizes, and by what follows."""
    sizes = F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9
    return sizes & (F.least(n - p, m - q) >= threshold / (1 + threshold) * (n + m) - 1e-9)


def prefix_pairs(rows: DataFrame, tokens: str, threshold: float, id_col: str = "id") -> DataFrame:
    """Candidate pairs (a, b), a < b, of all rows whose Jaccard similarity may reach ``threshold``.

    Tokens are ordered by rarity. Two sets above the threshold share one of
    their n - ceil(threshold * n) + 1 rarest tokens, so only these meet in the
    join, and frequent tokens hardly ever do; pairs whose sizes or remaining
    tokens rule them out go in the join itself. Rows with equal sets are to meet
    as one class, so copies add no pairs here.
    """
    one = prefixes(rows, tokens, threshold, id_col)
    other = one.withColumnsRenamed({"id": "b", "n": "m", "p": "q"})
    good = (F.col("a") < F.col("b")) & may_reach(threshold, F.col("n"), F.col("p"), F.col("m"), F.col("q"))
    return one.withColumnRenamed("id", "a").join(other, "token").filter(good).select("a", "b").distinct()


def both_pairs(rows: DataFrame, first: str, second: str, threshold: float, id_col: str = "id") -> DataFrame:
    """Candidate pairs (a, b), a < b, whose similarity may reach ``threshold`` (above 0) in both sets: they share a rare token of each, as one key."""
    x = prefixes(rows, first, threshold, id_col).withColumnsRenamed({"n": "n1", "p": "p1", "token": "t1"})
    y = prefixes(rows, second, threshold, id_col).withColumnsRenamed({"n": "n2", "p": "p2", "token": "t2"})
    one = x.join(y, "id")
    other = one.withColumnsRenamed({"id": "b", "n1": "m1", "p1": "q1", "n2": "m2", "p2": "q2"})
    good = F.col("a") < F.col("b")
    for k in "12":
        good = good & may_reach(threshold, *(F.col(c + k) for c in "npmq"))
    return one.withColumnRenamed("id", "a").join(other, ["t1", "t2"]).filter(good).select("a", "b").distinct()


def similar_classes(rows: DataFrame, tokens: str, threshold: float, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of equal sets whose Jaccard similarity exceeds ``threshold``, and the members.

    A class is named by its smallest id. The first frame is (src, dst, weight)
    with src < dst between different classes; the second (id, class, n) holds
    every row's class and its size: members of one class are alike (weight 1)
    and share all its links, so copies aren't expanded into pairs. Rows without
    tokens are in no class.
    """
    key = F.array_sort(F.array_distinct(tokens))
    named = rows.select(F.col(id_col).alias("id"), key.alias("set")).filter(F.size("set") > 0)
    classes = named.groupBy("set").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"))
    members = named.join(classes, "set").select("id", "class", "n")
    found = prefix_pairs(classes, "set", threshold, "class")
    of = classes.select("class", "set")
    pairs = found.join(of.withColumnsRenamed({"class": "a", "set": "x"}), "a").join(of.withColumnsRenamed({"class": "b", "set": "y"}), "b")
    pairs = pairs.withColumn("weight", sets.jaccard(F.col("x"), F.col("y"))).filter(F.col("weight") > threshold)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), members
