"""Concepts, gaps, hypotheses (survey A11-A13, E6, E7, E16, G2, J2-J4, T1, T2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sets
from .components import connected_components
from .graph import degrees
from .setjoin import prefix_pairs

# Bonuses by type, confidence and priority by kind of gap, groups of related topics.
TYPE_BONUS = {"identity": 0.2, "generalization": 0.15, "functional_equation": 0.1, "transformation": 0.1, "series": 0.1, "composition": 0.05, "limit": 0.05}
GAP_SCORES = {"sparse": (0.8, 0.5), "disconnected": (0.7, 0.8), "variation": (0.6, 0.5), "transformation": (0.5, 0.4), "domain": (0.4, 0.3)}
TOPIC_GROUPS = [
    ["algebra", "polynomial", "quadratic"], ["calculus", "derivative", "integral", "limits"], ["trigonometry", "periodic", "sine", "cosine"], ["geometry", "circle", "triangle", "area"],
    ["complex_analysis", "complex", "euler"], ["statistics", "probability", "distribution"],
]


def concept_id(symbols: Column, classes: Column, formula: Column) -> Column:
    """Sorted symbols and node classes, joined; a digest of the formula where it has neither."""
    own = F.concat(F.array_sort(F.array_distinct(symbols)), F.array_sort(F.array_distinct(classes)))
    return F.when(F.size(own) > 0, F.array_join(own, "_")).otherwise(F.concat(F.lit("concept_"), F.left(F.md5(formula), F.lit(8))))


def concepts(formulas: DataFrame, concept: str = "concept", formula: str = "formula", topic: str = "topic") -> DataFrame:
    """(concept, n, topics): formulas of each concept and its topics."""
    return formulas.groupBy(concept).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(formula).alias("formulas"), F.array_sort(F.collect_set(topic)).alias("topics"))


def sparse_concepts(nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Concepts (node, n, topics) with fewer than ``least`` links, none included, and their priority."""
    priority = F.least(F.lit(1.0), 0.5 + F.when(F.col("n") > 1, 0.2).otherwise(0.0) + F.when(F.size("topics") > 0, 0.1).otherwise(0.0))
    return degrees(edges, nodes).filter(F.col("degree") < least).withColumn("priority", priority)


def domain_gaps(rows: DataFrame, topic: str = "topic", share: float = 0.5) -> DataFrame:
    """Topics with fewer than ``share`` of the mean count."""
    counts = rows.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.avg("n").alias("m")).first()["m"]
    return counts.filter(F.col("n") < F.lit(float(share * (mean or 0)))).withColumn("mean", F.lit(float(mean or 0)))


def neighbor_pairs(rows: DataFrame, group: str, order: str, value: str, first: int = 10, ahead: int = 4, most: int = 5, same: str | None = None) -> DataFrame:
    """(group, a, b) among the first rows of each group and the next ``ahead``: pairs with different values, and equal, not empty sets in ``same`` where given; the first ``most`` by place."""
    w = Window.partitionBy(group).orderBy(order)
    alike = F.array_sort(F.array_distinct(same)) if same else F.lit(None)
    top = rows.withColumn("__s", alike).withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= first + ahead)
    later = F.array(*(F.struct(F.lit(k).alias("k"), F.lead(value, k).over(w).alias("v"), F.lead(order, k).over(w).alias("o"), F.lead("__s", k).over(w).alias("s")) for k in range(1, ahead + 1)))
    pairs = top.withColumn("__l", later).filter(F.col("__i") <= first).select(group, F.col(order).alias("a"), F.col(value).alias("x"), "__i", "__s", F.explode("__l").alias("l"))
    good = pairs.filter(F.col("l.v").isNotNull() & (F.col("l.v") != F.col("x")))
    if same:
        good = good.filter((F.col("l.s") == F.col("__s")) & (F.size("__s") > 0))
    place = Window.partitionBy(group).orderBy("__i", "l.k")
    return good.withColumn("__n", F.row_number().over(place)).filter(F.col("__n") <= most).select(group, "a", F.col("l.o").alias("b"))


def related_components(nodes: DataFrame, edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Classes of unlinked components by their topics and topic groups, and the pairs of classes that share one: (a, b, shared), and the members (component, class, n).

    Components with equal topics are one class, named by the smallest; the pairs
    within a class of more than one are implied by its size. Classes meet on
    topics and groups by an equi-join. ``nodes`` (node, topics).
    """
    label = connected_components(edges, cut)
    named = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = F.create_map(*(x for i, g in enumerate(TOPIC_GROUPS) for t in g for x in (F.lit(t), F.lit(f"group {i}"))))
    keyed = named.select("component", F.explode("topics").alias("topic"))
    keys = keyed.select("component", F.explode(F.array_compact(F.array("topic", F.try_element_at(groups, F.col("topic"))))).alias("key")).distinct()
    sets_ = cut(keys.groupBy("component").agg(F.array_sort(F.collect_list("key")).alias("keys")))
    classes = sets_.groupBy("keys").agg(F.min("component").alias("class"), F.count(F.lit(1)).alias("n"))
    members = sets_.join(classes, "keys").select("component", "class", "n")
    each = classes.select("class", F.explode("keys").alias("key"))
    other = each.withColumnRenamed("class", "b")
    pairs = each.withColumnRenamed("class", "a").join(other, "key").filter("a < b").groupBy("a", "b").agg(F.array_sort(F.collect_set("key")).alias("shared"))
    return pairs, members


def rank_gaps(gaps: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """By 0.6 of the confidence and 0.4 of the priority, first come first on ties."""
    return gaps.withColumn("rank_score", F.col("confidence") * 0.6 + F.col("priority") * 0.4).orderBy(F.desc("rank_score"), ordinal)


def hypothesis_rank(confidence: Column, kind: Column, sources: Column) -> Column:
    bonus = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in TYPE_BONUS.items() for x in p)), kind), F.lit(0.0))
    return F.least(F.lit(1.0), confidence + bonus + F.when(sources > 1, 0.1).otherwise(0.0))


def promising(rows: DataFrame, least: float = 0.7) -> DataFrame:
    return rows.filter((F.col("confidence") >= least) & F.col("status").isin("validated", "promising"))


def related_concepts(nodes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(src, dst, weight) of concepts (node, topics, symbols) with 0.6 J(topics) + 0.4 J(symbols) above ``threshold``.

    Concepts with equal topics and symbols are one class, named by the smallest
    node. A pair without a shared symbol needs more than threshold / 0.6 of its
    topics, one without a shared topic threshold / 0.4 of its symbols: these
    meet on rare tokens. The others share a topic and a symbol, and meet on both
    as one key, unless their sizes rule the score out.
    """
    own = nodes.select("node", F.array_sort(F.array_distinct("topics")).alias("topics"), F.array_sort(F.array_distinct("symbols")).alias("symbols"))
    classes = own.groupBy("topics", "symbols").agg(F.min("node").alias("c"))
    one = classes.select(F.col("c").alias("a"), F.size("topics").alias("n1"), F.size("symbols").alias("n2"), F.explode("topics").alias("t"), "symbols").withColumn("s", F.explode("symbols")).drop("symbols")
    share = lambda x, y: F.least(x, y) / F.greatest(x, y)
    most = 0.6 * share(F.col("n1"), F.col("m1")) + 0.4 * share(F.col("n2"), F.col("m2"))
    both = one.join(one.withColumnsRenamed({"a": "b", "n1": "m1", "n2": "m2"}), ["t", "s"]).filter((F.col("a") < F.col("b")) & (most > threshold - 1e-9)).select("a", "b")
    for c, weight in (("topics", 0.6), ("symbols", 0.4)):
        if threshold / weight <= 1:
            both = both.unionByName(prefix_pairs(classes, c, threshold / weight, "c"))
    pairs = both.distinct().withColumnsRenamed({"a": "src", "b": "dst"})
    x, y = classes.withColumnsRenamed({"c": "src", "topics": "tx", "symbols": "sx"}), classes.withColumnsRenamed({"c": "dst", "topics": "ty", "symbols": "sy"})
    score = sets.jaccard(F.col("tx"), F.col("ty")) * 0.6 + sets.jaccard(F.col("sx"), F.col("sy")) * 0.4
    return pairs.join(x, "src").join(y, "dst").select("src", "dst", score.alias("weight")).filter(F.col("weight") > threshold)


def holds_preconditions(symbols: Column, known: Column) -> Column:
    """No symbol beyond the known ones and the constants."""
    return F.size(F.array_except(symbols, F.array_union(known, F.array(*(F.lit(c) for c in ("pi", "E", "e")))))) == 0
