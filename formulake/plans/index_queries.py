"""Queries on vectors within a radius and on written indexes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import cut, scratch
from ..operators import cluster, graph, index, paging, radius
from ..sources import folders, nodes
from ..streaming import expiry
from . import corpus
from .parity_queries import density_sql
from .registry import cte, query, sub, table, text
from .relational_queries import FUZZY, PRINTS, S, r
from .relational_queries import _prints as fingerprints

# Every embedding, and a second one some way along its first place.
SHIFT = "(vec_id % 9 + 1) * 0.11"
VECTORS = f"""given AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), vectors AS (SELECT id, v FROM given UNION ALL SELECT -1 - vec_id, list_prepend(embedding[1]::DOUBLE + {SHIFT}::DOUBLE, embedding[2:]::DOUBLE[]) FROM embeddings)"""
NEAR = "near AS (SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS weight FROM vectors a JOIN vectors b ON a.id < b.id AND list_distance(a.v, b.v) <= 0.5)"


def _vectors(spark, d):
    own = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    shifted = F.concat(F.array(F.col("v")[0] + F.expr(SHIFT).cast("double")), F.slice("v", F.lit(2), F.size("v") - 1))
    return own.select(F.col("vec_id").alias("id"), "v").unionByName(own.select((-1 - F.col("vec_id")).alias("id"), shifted.alias("v")))


@query("vector_links", cte(VECTORS, NEAR) + "SELECT src, dst, round(weight, 6) AS weight FROM near")
def vector_links(spark, d):
    links, _ = radius.vector_links(_vectors(spark, d), "v", 0.5)
    return links.withColumn("weight", F.round("weight", 6))


@query("embedding_clusters", f"WITH RECURSIVE {VECTORS}, {NEAR}, links AS (SELECT src, dst FROM near), sizes AS (SELECT id AS class, 1 AS n FROM vectors), {density_sql(2)} SELECT id, coalesce(cluster, -1) AS label FROM vectors LEFT JOIN found ON id = class")
def embedding_clusters(spark, d):
    return cluster.vector_clusters(_vectors(spark, d), "v", cut, 0.5, 2)


# -- a written index -----------------------------------------------------------------------------------------

SIX = ("p_name", "p_made", "p_brand", "p_type", "p_box", "p_code")
ASKED = ["ECO", "ring", "Brand#1", "bolt made#", "small", "#2", "l ring made#0 brand#2 economy box 11 code", "box 5 code-7", "no such text", "x"]
CODED = "part_ AS (SELECT *, 'made#' || (p_partkey % 5) AS p_made, 'box ' || p_size AS p_box, 'code-' || (p_partkey % 89) AS p_code FROM part)"
LOWERED = f"lower(concat_ws(' ', {', '.join(SIX)}))"
# Parts after changes: some get another name, some go, a few come back.
CHANGED = f"""{CODED}, changed AS (SELECT * REPLACE (CASE WHEN p_partkey % 7 = 0 THEN 'small ring again' WHEN p_partkey % 22 = 0 THEN 'bolt come back' ELSE p_name END AS p_name) FROM part_ WHERE p_partkey % 11 <> 0 OR p_partkey % 22 = 0)"""


def _parts(spark, d):
    return table(spark, d, "part").selectExpr("*", "concat('made#', p_partkey % 5) AS p_made", "concat('box ', p_size) AS p_box", "concat('code-', p_partkey % 89) AS p_code")


def _index(folder: str, *words: str) -> index.Index:
    return index.Index(folder, SIX, words, "p_partkey", 32)


def _each(spark, own, asked):
    out = [index.substring_search(spark, own, q).select(F.lit(q).alias("query"), F.col("p_partkey").alias("id")) for q in asked]
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return out[0]


@query("substring_index", cte(CODED) + " UNION ALL ".join(f"SELECT {text(q)} AS query, p_partkey AS id FROM part_ WHERE contains({LOWERED}, lower({text(q)}))" for q in ASKED if len(q) > 1))
def substring_index(spark, d):
    with scratch(spark, "index") as folder:
        own = _index(folder)
        index.apply_batch(own, _parts(spark, d))
        return cut(_each(spark, own, ASKED))


@query("fuzzy_index", cte(FUZZY) + f"SELECT id, {r('score')} AS score FROM fuzzy WHERE score >= 0.4")
def fuzzy_index(spark, d):
    with scratch(spark, "index") as folder:
        own = _index(folder, "p_name", "p_type")
        index.apply_batch(own, _parts(spark, d))
        return cut(index.fuzzy_search(spark, own, "Small ring bolt", 0.4).withColumn("score", F.round("score", S)))


def _changed(spark, d, folder) -> index.Index:
    """An index over three batches, compacted, and one more batch."""
    parts, own, k = _parts(spark, d), _index(folder, "p_name", "p_type"), F.col("p_partkey")
    index.apply_batch(own, parts, batch=0)
    index.apply_batch(own, parts.filter(k % 7 == 0).withColumn("p_name", F.lit("small ring again")), batch=1)
    index.delete(own, parts.filter(k % 11 == 0).select("p_partkey"), batch=2)
    index.compact(spark, own)
    index.apply_batch(own, parts.filter(k % 22 == 0).withColumn("p_name", F.when(k % 7 == 0, F.lit("small ring again")).otherwise(F.lit("bolt come back"))), batch=3)
    return own


@query("index_changes", cte(CHANGED) + " UNION ALL ".join(f"SELECT {text(q)} AS query, p_partkey AS id FROM changed WHERE contains({LOWERED}, {text(q)})" for q in ("ring again", "come back", "eco", "gear")))
def index_changes(spark, d):
    with scratch(spark, "index") as folder:
        return cut(_each(spark, _changed(spark, d, folder), ["ring again", "come back", "eco", "gear"]))


@query("index_changes_fuzzy", cte(CHANGED, FUZZY.replace("FROM part)", "FROM changed)")) + f"SELECT id, {r('score')} AS score FROM fuzzy WHERE score >= 0.4")
def index_changes_fuzzy(spark, d):
    with scratch(spark, "index") as folder:
        return cut(index.fuzzy_search(spark, _changed(spark, d, folder), "Small ring bolt", 0.4).withColumn("score", F.round("score", S)))


# -- files ---------------------------------------------------------------------------------------------------

FILES_SQL = "files AS (SELECT doc_id % 24 AS part, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents_ GROUP BY 1)"


def _write_tex(spark, d, folder) -> None:
    """A folder of LaTeX files, one for each remainder of the key."""
    docs = corpus.documents(spark, d).withColumn("part", F.col("doc_id") % 24)
    docs.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text").write.partitionBy("part").text(folder)


def _digests(read):
    return read.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part"), F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("folder_documents", cte(corpus.DOCUMENTS_SQL, FILES_SQL) + f"SELECT part, length(cleaned)::INT AS n_chars, md5(cleaned) AS digest FROM (SELECT part, {sub('text', ('%[^' + chr(92) + 'n]*' + chr(92) + 'n', ''))} AS cleaned FROM files)")
def folder_documents(spark, d):
    with scratch(spark, "tex") as folder:
        _write_tex(spark, d, folder)
        return cut(_digests(folders.cleaned(folders.read_folder(spark, folder)).filter(F.col("error").isNull())))


@query("folder_stream", cte(corpus.DOCUMENTS_SQL, FILES_SQL) + "SELECT part, length(text)::INT AS n_chars, md5(text) AS digest FROM files")
def folder_stream(spark, d):
    with scratch(spark, "tex") as folder:
        _write_tex(spark, d, f"{folder}/in")
        for _ in range(2):  # the second run finds nothing new
            folders.follow_folder(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
        return cut(_digests(spark.read.parquet(f"{folder}/out")))


# -- metrics by age ------------------------------------------------------------------------------------------


@query("recent_metrics", f"SELECT event_type, count(*) AS n, {r('avg(value)')} AS mean, min(value) AS least, max(value) AS most FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 50 HOUR GROUP BY event_type")
def recent_metrics(spark, d):
    return expiry.recent_metrics(table(spark, d, "events"), "ts", "event_type", "value", 50).withColumn("mean", F.round("mean", S))


@query("expiring_metrics", f"""SELECT event_type AS operation, count(*) AS n, {r('sum(value) / count(*)')} AS mean, min(value) AS least, max(value) AS most FROM events
 WHERE floor(epoch(ts) / 60) * 60 + 60 + 50 * 3600 > (SELECT epoch(max(ts)) FROM events) - 600 GROUP BY event_type""")
def expiring_metrics(spark, d):
    with scratch(spark, "events") as folder:
        table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(f"{folder}/in")
        events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{folder}/in")
        told = expiry.expiring_metrics(events, "ts", "event_type", "value", 50)
        expiry.follow_metrics(told, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
        return cut(expiry.newest(spark.read.parquet(f"{folder}/out")).withColumn("mean", F.round("mean", S)))


# -- pages and nodes -----------------------------------------------------------------------------------------


@query("deep_page", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 975")
def deep_page(spark, d):
    with scratch(spark, "pages") as folder:
        paging.build_pages(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), folder, "o_orderpriority", F.desc("o_totalprice"), "o_orderkey", range_rows=400)
        return cut(paging.Pages(spark, folder).page(40, 25)[0].drop("rank"))


WRITTEN = "written AS (SELECT l_partkey, min(l_returnflag) AS status FROM lineitem WHERE l_partkey % 40 = 1 GROUP BY 1)"


@query("graph_update", cte(WRITTEN) + "SELECT p_partkey AS node_id, p_name, coalesce(status, p_type) AS status FROM part LEFT JOIN written ON l_partkey = p_partkey")
def graph_update(spark, d):
    with scratch(spark, "nodes") as folder:
        nodes.write_nodes(table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), "p_name", F.col("p_type").alias("status")), folder, buckets=64)
        results = table(spark, d, "lineitem").filter(F.col("l_partkey") % 40 == 1).select(F.col("l_partkey").alias("node_id"), F.col("l_returnflag").alias("status"))
        nodes.update_nodes(spark, folder, results, ["status"], buckets=64)
        return cut(nodes.read_nodes(spark, folder))


# -- graphs --------------------------------------------------------------------------------------------------

SOLD = "sold AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, sum(l_quantity)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2)"


def _sold(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.col("l_quantity").cast("double").alias("weight"))


@query("related_nodes", cte(SOLD) + "SELECT node, place::INT AS place, other, weight FROM (SELECT node, other, weight, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS place FROM (SELECT a AS node, b AS other, weight FROM sold UNION ALL SELECT b, a, weight FROM sold)) WHERE place <= 5")
def related_nodes(spark, d):
    return graph.related(_sold(spark, d), 5)


@query("spectral_layout")
def spectral_layout(spark, d):
    # Nodes are known up to the signs of their coordinates.
    made, _ = graph.spectral(_sold(spark, d))
    return made.select("node", F.round(F.abs(F.col("x")[0]), 4).alias("x"), F.round(F.abs(F.col("x")[1]), 4).alias("y"))


DEEP = f"""deep AS (SELECT *, p_brand || ' ' || p_type AS cluster, p_size % 5 + 1 AS depth, list_filter([CASE WHEN p_size % 2 = 0 THEN 'even' END, CASE WHEN p_size % 3 > 0 THEN 'odd' END, 'any'], lambda x: x IS NOT NULL) AS symmetries FROM part JOIN prints ON id = p_partkey)"""


@query("cluster_report", cte(PRINTS, DEEP, "s AS (SELECT cluster, count(*) AS size, avg(depth) AS md, min(depth) AS ld, max(depth) AS xd FROM deep GROUP BY 1)") + f"""SELECT s.cluster, size, {r("md")} AS mean_depth, ld AS least_depth, xd AS most_depth,
 (SELECT count(DISTINCT t) FROM (SELECT unnest(symbols) AS t FROM deep WHERE deep.cluster = s.cluster)) AS distinct_symbols,
 (SELECT coalesce(array_to_string(list_sort(list(t)), ','), '') FROM (SELECT t, count(*) AS k FROM (SELECT unnest(symmetries) AS t FROM deep WHERE deep.cluster = s.cluster) GROUP BY t) WHERE k = size) AS common_symmetries FROM s""")
def cluster_report(spark, d):
    part = table(spark, d, "part")
    sides = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, F.lit("even")), F.when(F.col("p_size") % 3 > 0, F.lit("odd")), F.lit("any")))
    more = part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5 + 1).alias("depth"), sides.alias("symmetries"))
    own = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_type").alias("cluster"))
    made = cluster.summarize(fingerprints(spark, d).join(more, "id"), own)
    return made.select("cluster", "size", F.round("mean_depth", S).alias("mean_depth"), "least_depth", "most_depth", "distinct_symbols", F.array_join("common_symmetries", ",").alias("common_symmetries"))


@query("spring_layout")
def spring_layout(spark, d):
    part = table(spark, d, "part")
    edges = part.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - F.col("p_partkey") % 16 + F.col("p_size") % 16).alias("dst"), F.lit(1.0).alias("weight"))
    made = graph.springs(part.select(F.col("p_partkey").alias("node")), edges, 3)
    return made.select("node", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
