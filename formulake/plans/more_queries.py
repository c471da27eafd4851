"""Further queries: readers' projections, filters, summaries, variations, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discover, search, strategy
from ..operators import expressions as X
from ..sources import documents as D
from ..sources import rules as R
from ..sources import writers
from . import corpus
from .expr_queries import RULE_ROWS, _equations, _formulas
from .registry import cte, query, table
from .relational_queries import FUZZY, T, _chain_edges, _jac, r


@query("flatten_formulas", """SELECT p_name || '_' || p_partkey || '_formula_' || i AS formula_id, f AS formula, NULL::VARCHAR AS known_identity FROM (SELECT p_name, p_partkey, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS f FROM (SELECT *, string_split(p_name, ' ') AS l FROM part))
 UNION ALL SELECT p_name || '_' || p_partkey || '_detailed_0', p_type, p_brand FROM part UNION ALL SELECT p_name || '_' || p_partkey || '_unicode_0', p_brand, NULL FROM part""")
def flatten_formulas(spark, d):
    t = table(spark, d, "part")
    detail = F.array(F.struct(F.col("p_type").alias("expression"), F.col("p_brand").alias("known_identity")))
    processed = t.select(F.concat_ws("_", "p_name", "p_partkey").alias("source"), F.split("p_name", " ").alias("formulas"), detail.alias("detailed_formulas"), F.create_map(F.lit("unicode"), F.array("p_brand")).alias("cleaned_formulas"))
    return D.flatten_formulas(processed)


@query("valid_theorems", cte(T) + "SELECT id % 4 = 0 AS bad_id, count(*) AS n, count(*) FILTER (id % 4 <> 0 AND confidence <= 0.9) AS valid FROM theorems GROUP BY 1")
def valid_theorems(spark, d):
    t = corpus.theorems(spark, d).withColumn("number", F.col("id"))
    name = F.when(F.col("number") % 4 == 0, F.lit("bad")).otherwise(F.concat(F.lit("THM_"), F.upper(F.left(F.md5(F.col("number").cast("string")), F.lit(8)))))
    conf = F.when(F.col("confidence") > 0.9, 1.5).otherwise(F.col("confidence"))
    rows = t.withColumns({"id": name, "source_lineage": F.struct(conf.alias("confidence")), "validation_evidence": F.struct("pass_rate", F.lit(3).alias("total_tests"))})
    valid, rejected = D.split_valid(rows)
    both = valid.select("number", F.lit(1).alias("good")).unionByName(rejected.select("number", F.lit(0).alias("good")))
    return both.groupBy((F.col("number") % 4 == 0).alias("bad_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("valid"))


@query("promising_hypotheses", cte(T) + "SELECT id FROM theorems WHERE confidence >= 0.7 AND CASE WHEN id % 3 = 0 THEN 'validated' WHEN id % 3 = 1 THEN 'promising' ELSE 'rejected' END IN ('validated', 'promising')")
def promising_hypotheses(spark, d):
    i = F.col("id") % 3
    return discover.promising(corpus.theorems(spark, d).withColumn("status", F.when(i == 0, "validated").when(i == 1, "promising").otherwise("rejected"))).select("id")


@query("rule_find", cte(RULE_ROWS) + "SELECT id, rule_type, priority FROM rules WHERE contains(pattern, 'sin') OR rule_type = 'logarithmic' ORDER BY priority DESC, id")
def rule_find(spark, d):
    return R.builtin(spark).filter(F.col("pattern").contains("sin") | (F.col("rule_type") == "logarithmic")).orderBy(F.desc("priority"), "id").select("id", "rule_type", "priority")


@query("preconditions", cte(T) + "SELECT id, len(list_filter(regexp_extract_all(statement, '[a-zA-Z]+'), lambda s: NOT list_contains(['x', 'y', 'pi', 'E', 'e'], s))) = 0 AS holds FROM theorems")
def preconditions(spark, d):
    own = F.regexp_extract_all("statement", F.lit("[a-zA-Z]+"), F.lit(0))
    return corpus.theorems(spark, d).select("id", discover.holds_preconditions(own, F.array(F.lit("x"), F.lit("y"))).alias("holds"))


CONCEPTS = "n AS (SELECT min(p_partkey) AS c, topics, symbols FROM (SELECT p_partkey, [p_type] AS topics, list_sort(list_distinct(string_split(p_name, ' '))) AS symbols FROM part) GROUP BY topics, symbols)"


@query("related_concepts", cte(CONCEPTS) + f"SELECT a.c AS src, b.c AS dst, {r('w')} AS weight FROM (SELECT a, b, 0.6 * {_jac('a.topics', 'b.topics')} + 0.4 * {_jac('a.symbols', 'b.symbols')} AS w FROM n a JOIN n b ON a.c < b.c) WHERE round(w, 9) > 0.3")
def related_concepts(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.array("p_type").alias("topics"), F.split("p_name", " ").alias("symbols"))
    return discover.related_concepts(t).withColumn("weight", F.round("weight", 6))


@query("graph_write_back", "SELECT p_partkey AS node_id, p_name, coalesce(status, p_type) AS status FROM part LEFT JOIN (SELECT l_partkey, min(l_returnflag) AS status FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def graph_write_back(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), "p_name", F.col("p_type").alias("status"))
    results = table(spark, d, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_returnflag").alias("status"))
    return writers.write_back(nodes, results, ["status"])


@query("search_summary", cte(FUZZY) + f"SELECT kind, count(*) AS n, {r('avg(score)')} AS mean_score FROM (SELECT CASE WHEN score >= 0.6 THEN 'close' ELSE 'far' END AS kind, score FROM fuzzy WHERE score > 0) GROUP BY kind")
def search_summary(spark, d):
    hits = search.fuzzy_search(table(spark, d, "part"), "Small ring bolt", ["p_name", "p_type"], 0.000001, "p_partkey")
    return hits.groupBy(F.when(F.col("score") >= 0.6, "close").otherwise("far").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("selected_theorems", cte(T) + "SELECT count(*) AS n FROM theorems WHERE theorem_type IN ('trigonometric', 'generalization') AND NOT validated AND confidence BETWEEN 0.25 AND 0.75")
def selected_theorems(spark, d):
    t = search.apply_filters(corpus.theorems(spark, d), search.Filters(types=["trigonometric", "generalization"], confidence=(0.25, 0.75)))
    return t.filter("NOT validated").agg(F.count(F.lit(1)).alias("n"))


@query("random_sample", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':42'), o_orderkey LIMIT 100")
def random_sample(spark, d):
    return search.sample(table(spark, d, "orders").select("o_orderkey"), 100, 42, "o_orderkey")


@query("degree_table", "WITH e AS (SELECT p_partkey AS src, p_partkey - p_partkey % 16 + p_size % 16 AS dst FROM part) SELECT degree, count(*) AS nodes FROM (SELECT p_partkey, count(n) AS degree FROM part LEFT JOIN (SELECT src AS n FROM e UNION ALL SELECT dst FROM e) ON n = p_partkey GROUP BY 1) GROUP BY degree")
def degree_table(spark, d):
    from ..operators import graph

    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return graph.degrees(_chain_edges(spark, d), nodes).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


@query("formula_variations")
def formula_variations(spark, d):
    return X.variations(_formulas(spark, d)).select("id", "variation")


@query("rule_applicability")
def rule_applicability(spark, d):
    return X.applicable_rules(_formulas(spark, d), strategy.with_reverse(R.builtin(spark))).select("id", "rule", "result")


@query("strategy_execution")
def strategy_execution(spark, d):
    return strategy.integrate(X.execute_strategies(_equations(spark, d), R.builtin(spark)))


@query("proof_trace")
def proof_trace(spark, d):
    return writers.proof_trace(X.rewrites(_formulas(spark, d), R.builtin(spark), steps=5).select("id", "step", "rule", "result"))


STEPS = "steps AS (SELECT l_orderkey AS id, l_linenumber AS step, l_returnflag AS rule, l_linestatus AS result FROM lineitem)"


@query("trace_text", cte(STEPS) + "SELECT id, string_agg('Step ' || step || ' [' || rule || ']: ' || result, chr(10) ORDER BY step, rule, result) AS text FROM steps GROUP BY id")
def trace_text(spark, d):
    t = table(spark, d, "lineitem")
    return writers.proof_trace(t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("step"), F.col("l_returnflag").alias("rule"), F.col("l_linestatus").alias("result"))).select("id", "text")


@query("flat_export", cte(T) + "SELECT id, array_to_string(symbols, '; ') AS symbols, array_to_string(chain, '; ') AS chain, source FROM theorems")
def flat_export(spark, d):
    return writers.flat(corpus.theorems(spark, d).select("id", "symbols", "chain", "source"))


