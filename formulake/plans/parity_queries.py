"""Queries for look-ups, graphs, traces, reports, histories, clusters on vectors, and proofs of known equations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import cut, scratch
from ..operators import cluster, discover, graph, search, strategy
from ..operators import expressions as X
from ..sources import documents as D
from ..sources import reports
from ..sources import rules as R
from . import corpus
from .registry import cte, query, table, text
from .relational_queries import CHAIN_EDGES, CHAIN_SCORE, FUZZY, POSTINGS, QUERY, RESULTS, Q, T, _chain_edges, _postings, _results, _rounded, density_sql, r

# -- search ------------------------------------------------------------------------------------------------

TOLD = f"""told AS (SELECT id, score, field, token, strpos({text(QUERY.lower())}, token) AS place FROM (SELECT p.id, p.field, p.token, (SELECT least(sum(idf * weight) / (SELECT count(*) FROM q), 1) FROM
 (SELECT y.weight, (SELECT count(*) FROM documents)::DOUBLE / (SELECT count(*) FROM postings z WHERE z.token = y.token) AS idf FROM postings y JOIN q ON y.token = q.token WHERE y.id = p.id)) AS score FROM postings p JOIN q ON p.token = q.token))"""


@query("text_search_top", cte(POSTINGS.replace(" AS (", " AS MATERIALIZED (", 1), Q, TOLD) + f"""SELECT id, {r('any_value(score)')} AS score, array_to_string(list_sort(list_distinct(list(field))), ',') AS fields,
 array_to_string((list('Matched ''' || token || ''' in ' || field ORDER BY place, field))[1:3], '; ') AS reasons FROM told GROUP BY id ORDER BY round(any_value(told.score), 9) DESC, id LIMIT 25""")
def text_search_top(spark, d):
    hits = search.text_search(_postings(spark, d), table(spark, d, "documents").count(), QUERY, 25)
    return _rounded(hits.withColumns({c: F.array_join(c, s) for c, s in (("fields", ","), ("reasons", "; "))}), "score")


ASKED = "asked AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN '∑ over i' WHEN 2 THEN p_name ELSE '  two words ' END AS q, CASE WHEN p_size % 2 = 0 THEN ['text', 'fuzzy'] ELSE ['text', 'symbol'] END AS kinds, p_size % 3 = 0 AS filtered FROM part)"
WORDS = r"len(list_filter(string_split_regex(trim(q), '\s+'), lambda w: w <> ''))"


@query("search_suggestions", cte(ASKED) + f"""SELECT id, array_to_string((list_filter([CASE WHEN NOT list_contains(kinds, 'fuzzy') THEN 'Try enabling **Fuzzy Search** for approximate matching' END, CASE WHEN NOT list_contains(kinds, 'symbol') AND regexp_matches(q, '[∀∃∈∑∏∫]') THEN 'Try enabling **Symbol Search** - your query contains mathematical symbols' END,
 CASE WHEN filtered THEN 'Try removing some **filters** to broaden your search' END, CASE WHEN {WORDS} > 3 THEN 'Try using **fewer keywords** for broader results' WHEN {WORDS} = 1 THEN 'Try adding **more descriptive terms** to your query' END], lambda s: s IS NOT NULL))[1:3], '; ') AS told FROM asked""")
def search_suggestions(spark, d):
    k = F.col("p_partkey") % 4
    asked = F.when(k == 0, "x").when(k == 1, "∑ over i").when(k == 2, F.col("p_name")).otherwise("  two words ")
    kinds = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("text"), F.lit("fuzzy"))).otherwise(F.array(F.lit("text"), F.lit("symbol")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(search.suggestions(asked, kinds, F.col("p_size") % 3 == 0), "; ").alias("told"))


@query("search_resort", cte(T) + "SELECT id, theorem_type, pass_rate FROM theorems ORDER BY pass_rate, id LIMIT 40")
def search_resort(spark, d):
    return search.ordered_by(corpus.theorems(spark, d), "validation", descending=False).select("id", "theorem_type", "pass_rate").limit(40)


@query("lookups", cte(T) + "SELECT id, theorem_type, statement FROM theorems WHERE id IN (3, 17, 101) UNION ALL SELECT id, theorem_type, statement FROM theorems WHERE theorem_type = 'logarithmic'")
def lookups(spark, d):
    t = corpus.theorems(spark, d).select("id", "theorem_type", "statement")
    return search.by_value(t, "id", 3, 17, 101).unionByName(search.by_value(t, "theorem_type", "logarithmic"))


@query("with_relevance", cte(FUZZY, T) + f"SELECT t.id, t.theorem_type, {r('f.score')} AS relevance FROM theorems t LEFT JOIN (SELECT * FROM fuzzy WHERE score >= 0.3) f ON t.id = f.id")
def with_relevance(spark, d):
    hits = search.fuzzy_search(table(spark, d, "part"), "Small ring bolt", ["p_name", "p_type"], 0.3, "p_partkey")
    return _rounded(search.with_relevance(corpus.theorems(spark, d), hits).select("id", "theorem_type", "relevance"), "relevance")


@query("first_of_each", cte(T) + "SELECT theorem_type, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY theorem_type ORDER BY confidence DESC, id) AS n FROM theorems) WHERE n <= 5")
def first_of_each(spark, d):
    return search.first_of_each(corpus.theorems(spark, d), "theorem_type", 5, F.desc("confidence"), "id").select("theorem_type", "id", "confidence")


# -- graphs ------------------------------------------------------------------------------------------------

GRAPH = f"""g_uses AS (SELECT DISTINCT id::VARCHAR AS id, unnest(symbols) AS symbol FROM theorems), g_chains AS (SELECT min(id::VARCHAR) AS class, count(*) AS n, chain AS s FROM theorems GROUP BY chain),
 g_edges AS (SELECT id AS src, 'SYM_' || symbol AS dst, 'contains_symbol' AS edge_type, 1.0::DOUBLE AS weight, 1 AS n FROM g_uses WHERE symbol IN (SELECT symbol FROM g_uses GROUP BY 1 HAVING count(*) >= 2)
 UNION ALL SELECT a.class, b.class, 'transformation_similarity', {CHAIN_SCORE}, a.n FROM g_chains a JOIN g_chains b ON a.class < b.class WHERE {CHAIN_SCORE} > 0.5
 UNION ALL SELECT id::VARCHAR, first, 'same_type', 0.8, n FROM (SELECT id, min(id::VARCHAR) OVER (PARTITION BY theorem_type) AS first, count(*) OVER (PARTITION BY theorem_type) AS n FROM theorems) WHERE id::VARCHAR <> first
 UNION ALL SELECT id::VARCHAR, first, 'same_source', 1.0, n FROM (SELECT id, min(id::VARCHAR) OVER (PARTITION BY source) AS first, count(*) OVER (PARTITION BY source) AS n FROM theorems) WHERE id::VARCHAR <> first)"""


@query("graph_build", cte(T, GRAPH) + f"SELECT edge_type, count(*) AS edges, sum(n)::BIGINT AS n, {r('sum(weight)')} AS weight FROM g_edges GROUP BY edge_type")
def graph_build(spark, d):
    _, edges = graph.build(corpus.theorems(spark, d))
    return _rounded(edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"), F.sum("n").alias("n"), F.sum("weight").alias("weight")), "weight")


@query("graph_simple_view", cte(T, GRAPH) + f"SELECT edge_type, count(*) AS edges, {r('sum(weight)')} AS weight FROM (SELECT arg_max(edge_type, o) AS edge_type, arg_max(weight, o) AS weight FROM (SELECT *, list_position(['contains_symbol', 'transformation_similarity', 'same_type', 'same_source'], edge_type) AS o FROM g_edges) GROUP BY least(src, dst), greatest(src, dst)) GROUP BY edge_type")
def graph_simple_view(spark, d):
    _, edges = graph.build(corpus.theorems(spark, d))
    return _rounded(graph.simple_view(edges).groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight")), "weight")


@query("graph_of_types", cte(T, GRAPH, "kept AS (SELECT id::VARCHAR AS node, 'theorem' AS node_type FROM theorems WHERE theorem_type IN ('trigonometric', 'logarithmic') UNION ALL SELECT DISTINCT dst, 'symbol' FROM g_edges WHERE edge_type = 'contains_symbol')", "inner_ AS (SELECT * FROM g_edges WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept))")
 + "SELECT node_type AS kind, count(*) AS n FROM kept WHERE node_type = 'theorem' OR node IN (SELECT dst FROM inner_) GROUP BY 1 UNION ALL SELECT edge_type, count(*) FROM inner_ GROUP BY 1")
def graph_of_types(spark, d):
    nodes, edges = graph.of_types(*graph.build(corpus.theorems(spark, d)), ["trigonometric", "logarithmic"])
    return nodes.groupBy(F.col("node_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).unionByName(edges.groupBy(F.col("edge_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@query("connection_analysis", cte(T, CHAIN_EDGES, "rel AS (SELECT DISTINCT src AS id, dst AS other FROM edges)", "n AS (SELECT rel.id, count(*) AS related, list_sort(list_distinct(list(theorem_type))) AS types FROM rel JOIN theorems t ON t.id = other GROUP BY 1)",
 "c AS (SELECT id, s, count(*) AS k FROM (SELECT rel.id, unnest(list_intersect(a.symbols, b.symbols)) AS s FROM rel JOIN theorems a ON a.id = rel.id JOIN theorems b ON b.id = other) GROUP BY 1, 2)")
 + "SELECT n.id, related, array_to_string(types, ',') AS types, coalesce((SELECT array_to_string((list_sort(list(s)))[1:10], ',') FROM c WHERE c.id = n.id AND k = related), '') AS shared FROM n")
def connection_analysis(spark, d):
    found = graph.shared_by(corpus.theorems(spark, d), _chain_edges(spark, d).select(F.col("src").alias("id"), F.col("dst").alias("other")))
    return found.select("id", "related", F.array_join("types", ",").alias("types"), F.array_join("shared", ",").alias("shared"))


# -- traces, reports, histories ------------------------------------------------------------------------------


def _traced(spark, d):
    return corpus.theorems(spark, d).withColumns({"total_tests": F.lit(109), "transformation": F.when(F.col("validated"), F.lit("expand"))})


@query("trace_methods", cte(T) + "SELECT id, symbolic + rule_based + validation AS steps, 3::BIGINT AS methods, symbolic, rule_based, validation FROM (SELECT id, CASE WHEN validated THEN 2 ELSE 1 END::BIGINT AS symbolic, len(chain)::BIGINT AS rule_based, 1 + least(len(symbols), 5)::BIGINT AS validation FROM theorems)")
def trace_methods(spark, d):
    return reports.steps_by_method(reports.trace_steps(_traced(spark, d)))


RULE_TEXT = "'Step ' || i || ': Apply ' || c || chr(10) || 'From: Previous step' || chr(10) || 'To: Transformed expression' || chr(10) || 'Rule: ' || c || chr(10) || 'Justification: Applied transformation rule: ' || c || chr(10) || 'Confidence: 90.00%' || chr(10) || repeat('-', 30) || chr(10) || chr(10)"


@query("trace_documents", cte(T) + f"SELECT id, 'Proof Steps (Rule_based)' || chr(10) || repeat('=', 50) || chr(10) || chr(10) || string_agg({RULE_TEXT}, '' ORDER BY i) AS text, count(*) AS steps FROM (SELECT id, generate_subscripts(chain, 1) AS i, unnest(chain) AS c FROM theorems) GROUP BY id")
def trace_documents(spark, d):
    made = reports.trace_texts(reports.trace_steps(_traced(spark, d)), "rule_based")
    return made.select("id", "text", F.size(F.from_json("json", "struct<steps:array<struct<n:int>>>")["steps"]).cast("long").alias("steps"))


@query("report_header", cte(T) + "SELECT theorem_type AS value, count(*) AS n, (SELECT count(*) FROM theorems) AS total FROM theorems GROUP BY theorem_type")
def report_header(spark, d):
    head = reports.header(corpus.theorems(spark, d), "total", {"type_distribution": "theorem_type"}, similarity_threshold=0.7)
    return head.select("total", F.explode("type_distribution").alias("value", "n"))


@query("strategy_history", cte(RESULTS) + f"SELECT strategy, 2 * count(*) AS total_attempts, 2 * count(*) FILTER (success) AS successes, {r('2 * sum(seconds)')} AS total_time, {r('avg(success::INT)')} AS success_rate, {r('avg(seconds)')} AS mean_time FROM results GROUP BY strategy")
def strategy_history(spark, d):
    results = _results(spark, d)
    return _rounded(strategy.history(results, strategy.history(results)), "total_time", "success_rate", "mean_time")


@query("concept_ids", cte(T) + "SELECT id, CASE WHEN id % 10 = 0 THEN 'concept_' || left(md5(statement), 8) ELSE array_to_string(list_sort(list_distinct(symbols)) || list_sort(list_distinct(chain)), '_') END AS concept FROM theorems")
def concept_ids(spark, d):
    none = F.expr("CAST(array() AS array<string>)")
    own = lambda c: F.when(F.col("id") % 10 == 0, none).otherwise(F.col(c))
    return corpus.theorems(spark, d).select("id", discover.concept_id(own("symbols"), own("chain"), F.col("statement")).alias("concept"))


@query("topic_tags", "SELECT p_brand AS cluster, array_to_string(list_sort(list_distinct(list(topic))), ',') AS topics FROM part JOIN (SELECT DISTINCT p_type AS f, left(p_name, 1) AS topic FROM part WHERE p_size % 4 = 0) ON p_type = f GROUP BY p_brand")
def topic_tags(spark, d):
    t = table(spark, d, "part")
    topics = t.filter("p_size % 4 = 0").select(F.col("p_type").alias("formula"), F.left("p_name", F.lit(1)).alias("topic"))
    return cluster.topic_tags(t.select(F.col("p_brand").alias("cluster"), F.col("p_type").alias("formula")), topics).select("cluster", F.array_join("topics", ",").alias("topics"))


# -- documents written and read again --------------------------------------------------------------------------


def _written(spark, head, items, name: str, order: str, read):
    """What ``read`` makes of a folder with the documents of ``items``, part by part; the folder goes afterwards."""
    return _read_back(spark, reports.document_parts(items, name, order, head, size=PART), read)


#: Items of a part, here few, so that small tables have several.
PART = 300


def _read_back(spark, parts, read):
    with scratch(spark, "documents") as folder:
        reports.write_parts(parts, folder)
        return cut(read(folder))


def _theorem_items(spark, d):
    t = corpus.theorems(spark, d)
    name = F.when(F.col("id") % 4 == 0, F.lit("bad")).otherwise(F.concat(F.lit("THM_"), F.upper(F.left(F.md5(F.col("id").cast("string")), F.lit(8)))))
    return t.select(name.alias("id"), "statement", "theorem_type", "symbols", F.struct(F.col("confidence"), F.col("chain").alias("transformation_chain")).alias("source_lineage"), F.struct("pass_rate", F.lit(3).alias("total_tests")).alias("validation_evidence"))


@query("theorem_documents", cte(T) + "SELECT theorem_type, count(*) FILTER (id % 4 <> 0) AS valid, count(*) FILTER (id % 4 = 0) AS rejected FROM theorems GROUP BY 1")
def theorem_documents(spark, d):
    def read(folder):
        valid, rejected = D.read_theorems(spark, folder)
        return valid.select("theorem_type", F.lit(1).alias("v")).unionByName(rejected.select("theorem_type", F.lit(0).alias("v"))).groupBy("theorem_type").agg(F.sum("v").alias("valid"), F.sum(1 - F.col("v")).alias("rejected"))

    items = _theorem_items(spark, d)
    return _written(spark, reports.header(items, "total_theorems", {"type_distribution": "theorem_type"}), items, "theorems", "id", read)


@query("hypothesis_documents", cte(T) + f"SELECT theorem_type AS hypothesis_type, count(*) AS n, {r('avg(confidence)')} AS confidence, sum(len(chain))::BIGINT AS steps FROM theorems GROUP BY 1")
def hypothesis_documents(spark, d):
    t = corpus.theorems(spark, d)
    items = t.select(F.col("id").cast("string").alias("hypothesis_id"), F.col("theorem_type").alias("hypothesis_type"), F.lit("validated").alias("status"), F.col("statement").alias("formula"), F.col("confidence").alias("confidence_score"), F.col("chain").alias("transformation_lineage"))
    head = reports.header(items, "total_hypotheses", {"status_distribution": "status", "type_distribution": "hypothesis_type"})
    found = _written(spark, head, items, "hypotheses", "hypothesis_id", lambda folder: D.read_hypotheses(spark, folder))
    return _rounded(found.groupBy("hypothesis_type").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence_score").alias("confidence"), F.sum(F.size("transformation_lineage")).alias("steps")), "confidence")


@query("formula_documents", cte(T) + "SELECT printf('FORMULA_%04d', i) AS id, statement AS formula FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS i, statement FROM theorems)")
def formula_documents(spark, d):
    """A list of formulas in files of some each."""
    parts = reports.document_parts(corpus.theorems(spark, d).select("id", "statement"), "formulas", "id", item=F.col("statement"), size=PART)
    return _read_back(spark, parts, lambda folder: D.read_formulas(spark, folder, PART)).select("id", "formula")


# -- clusters --------------------------------------------------------------------------------------------------


PLACES = "v AS (SELECT p_partkey AS id, (p_size % 13) * 1.5::DOUBLE AS x, (p_partkey % 97) * 0.7::DOUBLE AS y FROM part), sizes AS (SELECT min(id) AS class, count(*) AS n, x, y FROM v GROUP BY x, y)"


@query("vector_clusters", f"""WITH RECURSIVE {PLACES}, links AS (SELECT a.class AS src, b.class AS dst FROM sizes a JOIN sizes b ON a.class < b.class WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.75), {density_sql(40)}
 SELECT id, coalesce(cluster, -1) AS label FROM v JOIN sizes USING (x, y) LEFT JOIN found USING (class)""")
def vector_clusters(spark, d):
    place = F.array((F.col("p_size") % 13) * 1.5, (F.col("p_partkey") % 97) * F.lit(0.7)).cast("array<double>")
    return cluster.vector_clusters(table(spark, d, "part").select(F.col("p_partkey").alias("id"), place.alias("v")), "v", cut, 0.75, 40)




# Pairs of formulas and the rules that lead from one to the other.
PATHS = [("sin(2*u)", "2*sin(u)*cos(u)", "double_angle_sine"), ("log(a*b)", "log(a) + log(b)", "logarithm_product"), ("sin(t)**2 + cos(t)**2", "1", "pythagorean_identity"), ("x", "y", None), ("sec(x)", "1/cos(x)", "secant_identity"), ("x", "x", "")]


@query("transformation_paths", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if p is None else text(p)}, FALSE)" for i, (_, _, p) in enumerate(PATHS)) + ") v(id, rules, cut_off)")
def transformation_paths(spark, d):
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(PATHS)], "id int, start string, goal string")
    return X.paths(pairs, strategy.with_reverse(R.builtin(spark))).select("id", F.array_join("rules", ",").alias("rules"), "cut_off")
