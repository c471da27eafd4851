"""Theorem graphs: edges, neighbourhoods, statistics (survey J6-J10, G1-G5, A25, A26)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import sets
from .components import connected_components
from .setjoin import similar_classes

# Weights of edges.
TYPE_WEIGHT, SOURCE_WEIGHT, SYMBOL_WEIGHT = 0.8, 1.0, 1.0


def symbol_edges(rows: DataFrame, symbols: str = "symbols", least: int = 2, id_col: str = "id") -> DataFrame:
    """(src, dst, edge_type, weight): rows to the symbols that ``least`` rows use."""
    uses = rows.select(F.col(id_col).alias("src"), F.explode(F.array_distinct(symbols)).alias("symbol"))
    often = uses.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")
    return uses.join(often, "symbol").select("src", F.concat(F.lit("SYM_"), "symbol").alias("dst"), F.lit("contains_symbol").alias("edge_type"), F.lit(SYMBOL_WEIGHT).alias("weight"))


def group_links(rows: DataFrame, column: str, edge_type: str, weight: float, id_col: str = "id") -> DataFrame:
    """Links of equal values of ``column``: every row to the smallest id of its group, with the group's size.

    A group is a clique; its pairs are implied by these links, not emitted.
    """
    least = rows.groupBy(column).agg(F.min(id_col).alias("dst"), F.count(F.lit(1)).alias("n"))
    return rows.join(least, column).filter(F.col(id_col) != F.col("dst")).select(F.col(id_col).alias("src"), "dst", F.lit(edge_type).alias("edge_type"), F.lit(weight).alias("weight"), "n")


def overlap_edges(rows: DataFrame, tokens: str = "symbols", threshold: float = 0.4, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Edges between classes of equal token sets with Jaccard above ``threshold``, and the members of the classes."""
    return similar_classes(rows, tokens, threshold, id_col)


def chain_edges(rows: DataFrame, chain: str = "chain", threshold: float = 0.5, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Edges between classes of equal chains whose similarity exceeds ``threshold``, and the members.

    A score above it needs Jaccard above threshold - 0.3, so those pairs are the candidates.
    """
    named = rows.select(F.col(id_col).alias("id"), F.col(chain).alias("chain")).filter(F.size("chain") > 0)
    classes = named.groupBy("chain").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"))
    members = named.join(classes, "chain").select("id", "class", "n")
    # Chains with equal sets in another order are classes of their own: link them through their set class.
    by_set = classes.select("class", F.array_sort(F.array_distinct("chain")).alias("set"), "chain")
    groups = by_set.groupBy("set").agg(F.min("class").alias("g"))
    pairs, _ = similar_classes(groups, "set", max(0.0, threshold - 0.3 - 1e-9), "g")
    grouped = by_set.join(groups, "set").select("class", "chain", "g")
    own = grouped.select(F.col("g").alias("src"), F.col("g").alias("dst")).distinct()
    ends = pairs.select("src", "dst").unionByName(own)
    left, right = grouped.withColumnsRenamed({"class": "a", "chain": "x", "g": "src"}), grouped.withColumnsRenamed({"class": "b", "chain": "y", "g": "dst"})
    both = ends.join(left, "src").join(right, "dst").filter("a <> b AND (src <> dst OR a < b)")
    scored = both.withColumn("weight", sets.chain_similarity(F.col("x"), F.col("y"))).filter(F.col("weight") > threshold)
    return scored.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight"), members


#: Relations of a graph, in the order in which they are laid over each other.
RELATIONS = ("contains_symbol", "transformation_similarity", "same_type", "same_source")


def build(rows: DataFrame, symbols: str = "symbols", chain: str = "chain", kind: str = "theorem_type", source: str = "source", threshold: float = 0.5, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes (node, node_type, theorem_type) of rows and symbols; edges (src, dst, edge_type, weight, n) of all relations, a bag.

    Ids are strings. Chains are compared class by class, types and sources link
    to the smallest id of their group: ``n`` is the size of the class or group
    for which a link stands.
    """
    own = rows.withColumn("__id", F.col(id_col).cast("string"))
    uses = symbol_edges(own, symbols, id_col="__id").withColumn("n", F.lit(1).cast("long"))
    pairs, members = chain_edges(own, chain, threshold, "__id")
    sizes = members.select(F.col("class").alias("src"), "n").distinct()
    moved = pairs.join(sizes, "src").select("src", "dst", F.lit("transformation_similarity").alias("edge_type"), "weight", "n")
    edges = uses.unionByName(moved)
    for column, name, weight in ((kind, "same_type", TYPE_WEIGHT), (source, "same_source", SOURCE_WEIGHT)):
        edges = edges.unionByName(group_links(own, column, name, weight, "__id").select("src", "dst", "edge_type", "weight", "n"))
    nodes = own.select(F.col("__id").alias("node"), F.lit("theorem").alias("node_type"), F.col(kind).alias("theorem_type"))
    named = uses.select(F.col("dst").alias("node"), F.lit("symbol").alias("node_type"), F.lit(None).cast("string").alias("theorem_type")).distinct()
    return nodes.unionByName(named), edges


def simple_view(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type, weight) with one edge for two nodes: that of the last relation, src before dst."""
    place = F.array_position(F.array(*map(F.lit, RELATIONS)), F.col("edge_type"))
    ends = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.struct(place.alias("o"), "edge_type", "weight").alias("e"))
    return ends.groupBy("src", "dst").agg(F.max("e").alias("e")).select("src", "dst", "e.edge_type", "e.weight")


def of_types(nodes: DataFrame, edges: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the theorems of some types and the symbols they use: induced edges, and no symbol without one."""
    kept = nodes.filter((F.col("node_type") == "symbol") | F.col("theorem_type").isin(*types))
    inner = subgraph(edges, kept.select("node"))
    linked = inner.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return kept.join(linked, "node", "left_semi").unionByName(kept.filter("node_type <> 'symbol'").join(linked, "node", "left_anti")), inner


def shared_by(rows: DataFrame, related: DataFrame, symbols: str = "symbols", kind: str = "theorem_type", id_col: str = "id", first: int = 10) -> DataFrame:
    """(id, related, types, shared): for each row its related rows' number and types, and the first symbols that all of them share with it.

    ``related`` (id, other). Symbols are counted, so no row's relations are gathered.
    """
    own = rows.select(F.col(id_col).alias("id"), F.array_distinct(symbols).alias("s"), F.col(kind).alias("k"))
    pairs = related.select("id", "other").distinct()
    others = pairs.join(own.withColumnsRenamed({"id": "other", "s": "t"}), "other")
    n = others.groupBy("id").agg(F.count(F.lit(1)).alias("related"), F.array_sort(F.collect_set("k")).alias("types"))
    each = others.join(own.select("id", "s"), "id").select("id", F.explode(F.array_intersect("s", "t")).alias("symbol"))
    common = each.groupBy("id", "symbol").agg(F.count(F.lit(1)).alias("c")).join(n.select("id", "related"), "id").filter("c = related")
    shared = common.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("symbol")), 1, first).alias("shared"))
    return n.join(shared, "id", "left").withColumn("shared", F.coalesce("shared", F.expr("CAST(array() AS array<string>)")))


def related(edges: DataFrame, k: int = 5, shards: int = 64) -> DataFrame:
    """(node, place, other, weight): for each node the ``k`` nodes with the greatest sum of weights of common edges, in either direction; ties to the smaller node.

    The best of each node are taken in every task, then in each of ``shards``
    parts of its neighbours, then of what is left, so a hub's neighbours are
    never sorted together.
    """
    ends = edges.select("src", "dst", "weight").filter("src <> dst")
    pairs = ends.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))

    def first(rows: DataFrame, *by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), "other"))
        return rows.withColumn("place", place).filter(F.col("place") <= k)

    sharded = both.withColumn("shard", F.pmod(F.xxhash64("other"), F.lit(shards)))
    return first(first(sharded, "node", "shard").drop("place", "shard"), "node").select("node", "place", "other", "weight")


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return connected_components(edges, cut)


def neighborhood(edges: DataFrame, start: list, radius: int) -> DataFrame:
    """(node, hops) within ``radius`` of the start nodes: one join for each hop."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = spark.createDataFrame([(s,) for s in start], f"node {kind}").withColumn("hops", F.lit(0))
    for hop in range(1, radius + 1):
        last = seen.filter(F.col("hops") == hop - 1).select(F.col("node").alias("src"))
        new = both.join(last, "src").select(F.col("dst").alias("node")).distinct().withColumn("hops", F.lit(hop))
        seen = seen.unionByName(new).groupBy("node").agg(F.min("hops").alias("hops"))
    return seen


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree), also of nodes without edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(ends, "node", "left").na.fill(0, ["degree"])


def statistics(edges: DataFrame, nodes: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row: nodes, edges, density, average degree, components, largest component, average clustering.

    Triangles are counted along edges from the end of lower degree, so no hub
    pairs up all its neighbours.
    """
    simple = cut(edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    degree = cut(degrees(simple, nodes))
    d = degree.select("node", "degree")
    ranked = simple.join(d.withColumnsRenamed({"node": "src", "degree": "ds"}), "src").join(d.withColumnsRenamed({"node": "dst", "degree": "dd"}), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    out = cut(ranked.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b")))
    wedges = out.join(out.withColumnRenamed("b", "c"), "a").filter("b < c")
    closed = wedges.join(simple.withColumnsRenamed({"src": "b", "dst": "c"}), ["b", "c"])
    triangles = closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    local = F.when(F.col("degree") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    clustering = degree.join(triangles, "node", "left").agg(F.avg(local).alias("clustering"), F.count(F.lit(1)).alias("n"), (F.sum("degree") / 2).cast("long").alias("m")).first()
    sizes = connected_components(simple, cut).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    joined = sizes.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.max("n").alias("top")).first()
    n, m = clustering["n"] or 0, clustering["m"] or 0
    alone = n - (joined["n"] or 0)
    row = (n, m, 2.0 * m / (n * (n - 1)) if n > 1 else 0.0, 2.0 * m / n if n else 0.0, (joined["k"] or 0) + alone, max(joined["top"] or 0, min(alone, 1)), clustering["clustering"] or 0.0)
    return edges.sparkSession.createDataFrame([row], "nodes long, edges long, density double, average_degree double, components long, largest long, clustering double")


def positions(nodes: DataFrame, layout: str = "circular", order: str = "node") -> DataFrame:
    """(node, x, y) on a circle, by the nodes' order; ``shell`` puts them on rings of 12, 24, 36 and so on, ``random`` anywhere in the unit square.

    The rank of a node is its count of smaller nodes by range partition, so nothing is sorted in one task.
    """
    if layout == "random":  # the same for the same node
        unit = lambda salt: F.pmod(F.xxhash64(F.col("node"), F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)
        return nodes.select("node", unit("x").alias("x"), unit("y").alias("y"))
    ranked = ranks(nodes, order)
    total = nodes.count()
    if layout == "circular":
        angle, radius = 2 * math.pi * (F.col("rank") - 1) / F.lit(float(max(total, 1))), F.lit(1.0)
    elif layout == "shell":
        ring = F.ceil((F.sqrt(1 + F.col("rank") * 2 / 3.0) - 1) / 2)  # ring r holds 12 r nodes, so rings up to r hold 6 r (r + 1)
        angle, radius = 2 * math.pi * (F.col("rank") - 1 - 6 * ring * (ring - 1)) / (12.0 * ring), ring.cast("double")
    else:
        raise ValueError(f"unknown layout {layout}")
    return ranked.select("node", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


#: Numbers that a node keeps for the steps of the spectral layout; when they are full, the best mixtures go on.
SPECTRAL_STEPS = 30
#: What the normalised Laplacian may move a vector by besides stretching it, for a vector of length 1.
SPECTRAL_ERROR = 1e-7
#: Links that a task of the spectral layout holds.
LINKS = 2_000_000


def spectral(edges: DataFrame, dims: int = 2, steps: int = SPECTRAL_STEPS) -> tuple[DataFrame, list[float]]:
    """(node, x) with ``dims`` coordinates, and their eigenvalues: of the normalised Laplacian the eigenvectors of the least eigenvalues after that of the constant one.

    Each vector has length 1 and is known up to its sign; several vectors of one
    eigenvalue are some basis of theirs. Edges are undirected, weights of common
    edges add up, loops are left out. A step is one join of the edges with the
    nodes' newest numbers, and two rows of sums; a node keeps ``steps`` numbers at
    most, and only a matrix of the steps reaches the driver. After ``steps`` steps
    it restarts from the best mixtures so far (thick restart) and goes on until
    the error of each vector is ``SPECTRAL_ERROR`` or less, however long it takes.
    """
    import numpy as np

    ends = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
    once = cut(ends.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    # Degrees scale the nodes' numbers instead of the links, which so meet no degrees.
    links = once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    links = cut(links.repartition(max(1, -(-once.count() // LINKS)), "dst").sortWithinPartitions("dst"))
    degree = cut(links.groupBy("dst").agg(F.sum("weight").alias("d")).withColumnRenamed("dst", "src"))
    n, total = (degree.agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("t")).first()[c] for c in ("n", "t"))
    if not n:
        return degree.select(F.col("src").alias("node"), F.array(F.col("d")).alias("x")), []
    unit = F.pmod(F.xxhash64(F.col("src"), F.lit("start")), F.lit(1 << 52)) / float(1 << 51) - 1.0  # the same for the same node
    state = degree.select("src", F.sqrt("d").alias("root"), F.array(F.sqrt(F.col("d") / total)).alias("q"), unit.alias("w"))
    sum_of = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    numbers = lambda own: F.array(*(F.lit(float(x)) for x in own))
    most = max(steps, dims + 3)
    kept, size, matrix = (most + dims) // 2, 1, np.zeros((most + 2, most + 2))
    while True:
        state = cut(state)
        square = F.sum(F.col("w") * F.col("w"))
        for again in (False, True):  # twice, so that the vectors stay orthogonal
            *dots, left = state.agg(*(F.sum(F.col("q")[i] * F.col("w")) for i in range(size)), square).first()
            if size > 1 and not again:
                matrix[size - 1, :size] = matrix[:size, size - 1] = dots
            state = state.withColumn("w", F.col("w") - sum_of("q", numbers(dots)))
        length = math.sqrt(max(0.0, left - sum(x * x for x in dots)))  # of what is left after the second time
        values, vectors = np.linalg.eigh(matrix[1:size, 1:size]) if size > 1 else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(-values)
        if length < 1e-10 or size > dims and (length * np.abs(vectors[-1, order[:dims]]) <= SPECTRAL_ERROR).all():
            break
        state = state.withColumn("w", F.col("w") / length)
        if size > most:
            mixed = [sum_of(F.slice("q", 2, size - 1), numbers(vectors[:, k])) for k in order[:kept]]
            state, matrix, size = state.withColumn("q", F.array(F.col("q")[0], *mixed)), np.zeros_like(matrix), kept + 1
            matrix[range(1, size), range(1, size)] = values[order[:kept]]
        state, size = state.select("src", "root", F.array_append("q", F.col("w")).alias("q")), size + 1
        newest = state.select(F.col("src").alias("dst"), (F.element_at("q", -1) / F.col("root")).alias("v"))
        sums = links.hint("merge").join(newest, "dst").groupBy("src").agg(F.sum(F.col("weight") * F.col("v")).alias("w"))
        state = state.join(sums.hint("merge"), "src", "left").select("src", "root", "q", (F.coalesce("w", F.lit(0.0)) / F.col("root")).alias("w"))
    best = order[:dims]
    mixed = [sum_of(F.slice("q", 2, size - 1), numbers(vectors[:, k])) for k in best]
    return state.select(F.col("src").alias("node"), F.array(*mixed).alias("x") if mixed else F.expr("CAST(array() AS array<double>)").alias("x")), [1.0 - float(values[k]) for k in best]


def springs(nodes: DataFrame, edges: DataFrame, steps: int = 50) -> DataFrame:
    """(node, x, y): neighbours attract each other, all nodes repel each other, and steps get shorter and shorter.

    Starts with ``positions`` at random in the unit square. Nodes repel by cells
    of twice the ideal distance: what stands in a cell and in the eight around it
    acts from its mean place with the weight of its number, and what is farther
    doesn't, so no pairs of nodes are formed but those of edges. Weights of
    common edges add up, loops are left out; the same graph gives the same layout.
    """
    ends = edges.filter("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    # Nodes, links and cells grow with the graph; the planner takes them for small where files compress well, so joins go by a shuffle.
    links = cut(ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    place = cut(positions(nodes.select("node").distinct(), "random"))
    ideal = 1.0 / math.sqrt(max(1, place.count()))
    width, apart = 2 * ideal, lambda d: F.greatest(d, F.lit(0.01 * ideal))
    for step in range(steps):
        celled = place.withColumn("cx", F.floor(F.col("x") / width)).withColumn("cy", F.floor(F.col("y") / width))
        cells = celled.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("m"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
        around = F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), F.lit(int(i == j == 0)).alias("own")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        seen = celled.select("node", "x", "y", F.explode(around).alias("c")).select("node", "x", "y", "c.*").join(cells.hint("merge"), ["cx", "cy"])
        others = F.col("m") - F.col("own")  # a node doesn't repel itself
        mean = lambda c: (F.col(f"s{c}") - F.col("own") * F.col(c)) / others
        seen = seen.filter(others > 0).select("node", others.alias("m"), (F.col("x") - mean("x")).alias("dx"), (F.col("y") - mean("y")).alias("dy"))
        seen = seen.withColumn("f", F.col("m") * ideal * ideal / F.pow(apart(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)), 2))
        pulled = links.join(place.withColumnsRenamed({"node": "dst", "x": "u", "y": "v"}).hint("merge"), "dst").join(place.withColumnRenamed("node", "src").hint("merge"), "src")
        pulled = pulled.select(F.col("src").alias("node"), (F.col("u") - F.col("x")).alias("dx"), (F.col("v") - F.col("y")).alias("dy"), "weight")
        pulled = pulled.withColumn("f", F.col("weight") * F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2) / ideal)
        moves = seen.select("node", "dx", "dy", "f").unionByName(pulled.select("node", "dx", "dy", "f")).groupBy("node").agg(F.sum(F.col("dx") * F.col("f")).alias("dx"), F.sum(F.col("dy") * F.col("f")).alias("dy"))
        most = 0.1 * (1 - step / (steps + 1))
        length = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
        to = lambda c: (F.col(c) + F.coalesce(F.col(f"d{c}") / apart(length) * F.least(length, F.lit(most)), F.lit(0.0))).alias(c)
        place = cut(place.join(moves.hint("merge"), "node", "left").select("node", to("x"), to("y")))
    return place


def ranks(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``rank`` from 1 by ``order``, from range partitions and their sizes."""
    # A table of its own: both uses see the same partitions, also after a retry.
    parts = cut(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    sizes = {r["__p"]: (r["n"], r["first"]) for r in parts.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("first")).collect()}  # a row a partition
    before, pairs = 0, []
    for p in sorted(sizes):
        n, first = sizes[p]
        pairs += [F.lit(p), F.lit(before - first)]
        before += n
    if not pairs:
        return rows.withColumn("rank", F.lit(0).cast("long"))
    return parts.withColumn("rank", F.col("__i") + F.create_map(*pairs)[F.col("__p")] + 1).drop("__p", "__i")
