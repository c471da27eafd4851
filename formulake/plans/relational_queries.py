"""Queries on bands, roll-ups, search, graphs, strategies and discovery, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import latex as L
from ..checkpoints import cut
from ..operators import cluster, discover, graph, search, strategy, validation
from . import corpus
from .registry import cte, query, sub, table, text

T = corpus.THEOREMS_SQL
S = 6  # digits of rounded numbers


def r(c: str) -> str:
    return f"round({c}, {S})"


def _rounded(df, *columns: str):
    return df.withColumns({c: F.round(c, S) for c in columns})


# -- bands and flags -----------------------------------------------------------------------------


@query("confidence_bands", """SELECT o_orderkey, CASE WHEN x >= 0.95 THEN 'Very High' WHEN x >= 0.9 THEN 'High' WHEN x >= 0.75 THEN 'Medium' ELSE 'Low' END AS shown,
 CASE WHEN x >= 0.8 THEN 'very_high' WHEN x >= 0.6 THEN 'high' WHEN x >= 0.4 THEN 'medium' WHEN x >= 0.2 THEN 'low' ELSE 'very_low' END AS integrated FROM (SELECT o_orderkey, (o_orderkey % 101) / 100.0::DOUBLE AS x FROM orders)""")
def confidence_bands(spark, d):
    x = (F.col("o_orderkey") % 101) / 100.0
    return table(spark, d, "orders").select("o_orderkey", B.confidence_level(x).alias("shown"), B.integrated_level(x).alias("integrated"))


@query("validation_insights", cte(T) + """SELECT id, array_to_string(list_filter([CASE WHEN pass_rate >= 0.95 THEN 'excellent' WHEN pass_rate >= 0.8 THEN 'good' WHEN pass_rate >= 0.6 THEN 'moderate' ELSE 'poor' END,
 CASE WHEN id % 150 < 10 THEN 'limited coverage' WHEN id % 150 > 100 THEN 'comprehensive coverage' END, CASE WHEN id % 15 > 10 THEN 'long validation' END], lambda x: x IS NOT NULL), '; ') AS insights FROM theorems""")
def validation_insights(spark, d):
    return corpus.theorems(spark, d).select("id", F.array_join(B.insights(F.col("pass_rate"), F.col("id") % 150, F.col("id") % 15), "; ").alias("insights"))


CATEGORY = "CASE WHEN len(list_distinct(symbols)) + id % 6 <= 2 THEN 'Simple' WHEN len(list_distinct(symbols)) + id % 6 <= 5 THEN 'Moderate' ELSE 'Complex' END"
VALID = "validated AND pass_rate >= 0.9"


@query("theorem_projections", cte(T) + f"""SELECT id, category, valid, CAST(trunc(least(10 + 40 * confidence * CASE WHEN valid THEN 1.0::DOUBLE ELSE 0.7 END * CASE category WHEN 'Moderate' THEN 1.2::DOUBLE WHEN 'Complex' THEN 1.4 ELSE 1 END, 50)) AS INTEGER) AS node_size,
 {r("CASE WHEN valid THEN 10 ELSE 0 END + confidence * 5")} AS importance FROM (SELECT *, {CATEGORY} AS category, {VALID} AS valid FROM theorems)""")
def theorem_projections(spark, d):
    t = corpus.theorems(spark, d).withColumn("category", B.complexity_category(F.col("symbols"), F.col("id") % 6)).withColumn("valid", B.is_validated(F.when(F.col("validated"), "PASS").otherwise("FAIL"), F.col("pass_rate")))
    c = F.col("confidence")
    return t.select("id", "category", "valid", B.node_size(c, F.col("valid"), F.col("category")).alias("node_size"), F.round(B.importance(c, F.col("valid"), F.col("statement")), S).alias("importance"))


@query("search_score", cte(T) + f"""SELECT id, {r("least((CASE WHEN contains(lower(statement), 'x') THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN contains(lower(source), 'x') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN contains(theorem_type, 'x') THEN 0.2::DOUBLE ELSE 0 END + 0) * CASE WHEN validated THEN 1.1::DOUBLE ELSE 1 END * (0.8 + 0.2 * confidence), 1)").replace("'x'", "'tri'")} AS score FROM theorems""")
def search_score(spark, d):
    t = corpus.theorems(spark, d)
    return t.select("id", F.round(B.search_score("Tri", F.col("statement"), F.col("source"), F.col("theorem_type"), F.col("symbols"), F.col("validated"), F.col("confidence")), S).alias("score"))


def _has(c: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {text(w)})" for w in words) + ")"


FLAGS = ", ".join(f"{_has('statement', v)} AS {k}" for k, v in B.CONTENT.items())
COMPLEXITY = "least((length(statement) - length(replace(statement, '+', '')) + length(statement) - length(replace(statement, '*', '')) + (length(statement) - length(replace(statement, '**', ''))) / 2 + length(statement) - length(replace(statement, '(', '')) + len(symbols)) / 15, 1)"
SCORE = "least((len(symbols) * 0.1::DOUBLE + (id % 9) * 0.15 + (id % 3) * 0.2 + (id % 4) * 0.1 + CASE WHEN trigonometric THEN 0.2 ELSE 0 END + CASE WHEN logarithmic THEN 0.15 ELSE 0 END) / 2, 1)"
CHARACTER = f"traits AS (SELECT *, {SCORE} AS complexity FROM (SELECT *, {FLAGS}, {COMPLEXITY} AS string_complexity FROM theorems))"


@query("characteristics", cte(T, CHARACTER) + f"SELECT id, trigonometric, logarithmic, exponential, rational, algebraic, {r('string_complexity')} AS string_complexity, {r('complexity')} AS complexity FROM traits")
def characteristics(spark, d):
    t = _traits(spark, d)
    return _rounded(t.select("id", *B.CONTENT, "string_complexity", "complexity"), "string_complexity", "complexity")


def _traits(spark, d):
    t = corpus.theorems(spark, d)
    t = t.select("*", *(B.holds(F.col("statement"), k).alias(k) for k in B.CONTENT), B.string_complexity(F.col("statement"), F.col("symbols")).alias("string_complexity"))
    i = F.col("id")
    return t.withColumn("complexity", B.complexity_score(F.size("symbols"), i % 9, i % 3, i % 4, F.col("trigonometric"), F.col("logarithmic")))


@query("symbol_categories", cte(T) + """SELECT symbol, count(*) AS n, CASE WHEN lower(symbol) IN ('x','y','z','a','b','c','n','m','k') THEN 'Variables' WHEN symbol IN ('+','-','*','/','=','<','>','≤','≥') THEN 'Operators'
 WHEN lower(symbol) IN ('sin','cos','tan','log','exp','sqrt') THEN 'Functions' WHEN lower(symbol) IN ('pi','e','phi') THEN 'Constants' ELSE 'Other' END AS category
 FROM (SELECT unnest(regexp_extract_all(statement, '[a-z]+|[*+/=-]')) AS symbol FROM theorems) GROUP BY symbol""")
def symbol_categories(spark, d):
    each = corpus.theorems(spark, d).select(F.explode(F.regexp_extract_all("statement", F.lit("[a-z]+|[*+/=-]"), F.lit(0))).alias("symbol"))
    return each.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("category", B.symbol_category(F.col("symbol")))


HINT = "CASE WHEN id % 5 = 0 THEN theorem_type ELSE '' END"
STATED = "CASE WHEN id % 7 = 0 THEN statement || ' = f(x)' WHEN id % 11 = 0 THEN statement || ' = 0' WHEN id % 13 = 0 THEN 'derivative ' || statement WHEN id % 17 = 0 THEN 'lim ' || id ELSE statement END"
EQUATION = "regexp_matches(e, '(^|[^<>=!])=($|[^=])')"
KIND = f"""CASE WHEN list_contains([{", ".join(map(text, B.HINTS))}], hint) THEN hint WHEN {_has("e", ["sin", "cos", "tan", "sec", "csc", "cot"])} THEN 'trigonometric' WHEN {_has("e", ["exp", "e**"])} THEN 'exponential' WHEN {_has("e", ["log", "ln"])} THEN 'logarithmic'
 WHEN {_has("e", ["diff", "integra", "derivative", "limit"])} THEN 'calculus' WHEN {EQUATION} AND contains(e, 'f(') THEN 'functional_equation' WHEN {EQUATION} THEN 'algebraic_identity' WHEN contains(e, '<') OR contains(e, '>') THEN 'inequality' WHEN contains(lower(e), 'lim') THEN 'limit_conjecture' ELSE 'algebraic_identity' END"""
DESCRIBED = " ".join(f"WHEN '{k}' THEN {text(s)} || e" for k, s in B.SENTENCES.items())
REAL = "list_transform(list_filter(list_sort(list_distinct(own)), lambda s: NOT list_contains(['f','g','h'], s)), lambda s: s || ' ∈ ℝ')"


@query("theorem_templates", cte(T) + f"""SELECT id, kind, CASE WHEN len(own) > 0 THEN '∀' || array_to_string(list_sort(list_distinct(own)), ', ') || ' ∈ ℝ, ' || e ELSE e END AS formal, CASE kind {DESCRIBED} WHEN 'algebraic_identity' THEN 'The expression ' || e || ' represents an algebraic identity'
 ELSE 'This mathematical relationship holds: ' || e END AS described, array_to_string(CASE WHEN kind = 'functional_equation' THEN {REAL} || list_transform(list_filter(list_sort(list_distinct(own)), lambda s: list_contains(['f','g','h'], s)), lambda s: s || ': ℝ → ℝ') ELSE {REAL} END, '; ') AS assumed
 FROM (SELECT *, {KIND} AS kind FROM (SELECT id, {HINT} AS hint, {STATED} AS e, regexp_extract_all(statement, '[a-z]') AS own FROM theorems))""")
def theorem_templates(spark, d):
    t = corpus.theorems(spark, d).select("id", F.expr(HINT).alias("hint"), F.expr(STATED).alias("e"), F.regexp_extract_all("statement", F.lit("[a-z]"), F.lit(0)).alias("own"))
    e, own = F.col("e"), F.col("own")
    t = t.withColumn("kind", B.classify(e, e, F.col("hint")))
    k = F.col("kind")
    return t.select("id", "kind", B.formal_statement(e, own).alias("formal"), B.describe(e, k).alias("described"), F.array_join(B.assumptions(own, k), "; ").alias("assumed"))


# -- validation roll-ups ---------------------------------------------------------------------------

TEST_TYPES = ["symbolic", "numerical", "edge_case", "round_trip"]
TESTS = f"tests AS (SELECT l_partkey AS formula_id, l_discount < 0.085 AS passed, l_tax > 0.075 AS errored, [{', '.join(map(text, TEST_TYPES))}][l_linenumber % 4 + 1] AS test_type FROM lineitem)"
ROLLED = """rolled AS (SELECT *, greatest(0, least(1, pass_rate - n_errors / total * 0.5::DOUBLE + CASE WHEN types >= 3 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN n_numerical >= 50 AND pass_rate > 0.9 THEN 0.1::DOUBLE ELSE 0 END)) AS confidence,
 CASE WHEN n_errors = total THEN 'ERROR' WHEN pass_rate >= 0.95 THEN 'PASS' WHEN pass_rate >= 0.7 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM (SELECT formula_id, count(*) AS total, count(*) FILTER (passed AND NOT errored) AS n_passed, count(*) FILTER (NOT passed AND NOT errored) AS n_failed,
 count(*) FILTER (errored) AS n_errors, count(DISTINCT test_type) AS types, count(*) FILTER (test_type = 'numerical') AS n_numerical, count(*) FILTER (passed AND NOT errored) / count(*)::DOUBLE AS pass_rate FROM tests GROUP BY 1))"""


def _rolled(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_partkey").alias("formula_id"), (F.col("l_discount") < 0.085).alias("passed"), (F.col("l_tax") > 0.075).alias("errored"), F.element_at(F.array(*(F.lit(x) for x in TEST_TYPES)), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("test_type"))
    return validation.roll_up(t)


@query("test_rollup", cte(TESTS, ROLLED) + f"SELECT formula_id, total, n_passed, n_failed, n_errors, types, n_numerical, {r('pass_rate')} AS pass_rate, {r('confidence')} AS confidence, status FROM rolled")
def test_rollup(spark, d):
    return _rounded(_rolled(spark, d), "pass_rate", "confidence")


@query("status_report", cte(TESTS, ROLLED) + f"""SELECT count(*) AS formulas, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'PARTIAL') AS n_partial, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'ERROR') AS n_error,
 {r("count(*) FILTER (status IN ('PASS', 'PARTIAL')) / count(*)::DOUBLE")} AS overall_pass_rate, {r("coalesce(avg(confidence) FILTER (confidence > 0), 0)")} AS average_confidence, {r("coalesce(avg(pass_rate) FILTER (pass_rate > 0), 0)")} AS average_pass_rate,
 sum(total)::BIGINT AS tests, sum(n_passed)::BIGINT AS passed_tests FROM rolled""")
def status_report(spark, d):
    return _rounded(validation.report(_rolled(spark, d)), "overall_pass_rate", "average_confidence", "average_pass_rate")


@query("first_errors", cte(TESTS, ROLLED) + "SELECT formula_id, n_errors, status FROM rolled WHERE n_errors > 0 ORDER BY formula_id LIMIT 10")
def first_errors(spark, d):
    return validation.first_errors(_rolled(spark, d))


@query("status_distribution", cte(TESTS, ROLLED) + "SELECT s.status, coalesce(n, 0) AS n FROM (SELECT unnest(['PASS', 'PARTIAL', 'FAIL', 'ERROR', 'UNKNOWN']) AS status) s LEFT JOIN (SELECT status, count(*) AS n FROM rolled GROUP BY 1) c ON s.status = c.status")
def status_distribution(spark, d):
    return validation.distribution(_rolled(spark, d), "status", [*validation.STATUSES, "UNKNOWN"])


@query("hypothesis_status", cte(TESTS, ROLLED) + f"""SELECT formula_id, CASE WHEN formula_id % 29 = 0 THEN 'error' WHEN status = 'PASS' THEN 'validated' WHEN status = 'PARTIAL' THEN 'promising' ELSE 'rejected' END AS status,
 {r("CASE WHEN formula_id % 29 = 0 THEN 0 WHEN status = 'PASS' THEN confidence WHEN status = 'PARTIAL' THEN confidence * 0.8 ELSE 0.1::DOUBLE END")} AS confidence FROM rolled""")
def hypothesis_status(spark, d):
    t = _rolled(spark, d).select("formula_id", validation.hypothesis_status(F.col("status"), F.col("confidence"), F.col("formula_id") % 29 == 0).alias("h"))
    return _rounded(t.select("formula_id", "h.*"), "confidence")


@query("operation_metrics", f"SELECT event_type, count(*) AS n, {r('avg(value)')} AS mean, min(value) AS least, max(value) AS most FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' GROUP BY event_type")
def operation_metrics(spark, d):
    t = table(spark, d, "events").filter(F.col("ts") > F.to_timestamp(F.lit("2024-01-10 00:00:00")))
    return _rounded(validation.operation_metrics(t, "event_type", "value"), "mean")


@query("symbol_frequency", cte(T) + f"SELECT symbol, count(*) AS n, {r('100.0::DOUBLE * count(*) / sum(count(*)) OVER ()')} AS percent FROM (SELECT unnest(symbols) AS symbol FROM theorems) GROUP BY symbol")
def symbol_frequency(spark, d):
    return _rounded(validation.frequency_table(corpus.theorems(spark, d).select(F.explode("symbols").alias("symbol")), "symbol"), "percent")


@query("collection_statistics", cte(T) + f"SELECT theorem_type, count(*) AS n, count(*) FILTER (validated) AS n_validated, {r('count(*) FILTER (validated) / count(*)::DOUBLE')} AS rate, {r('avg(confidence)')} AS mean_confidence FROM theorems GROUP BY theorem_type")
def collection_statistics(spark, d):
    t = corpus.theorems(spark, d).groupBy("theorem_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("validated").alias("n_validated"), F.avg(F.col("validated").cast("int")).alias("rate"), F.avg("confidence").alias("mean_confidence"))
    return _rounded(t, "rate", "mean_confidence")


# -- search ------------------------------------------------------------------------------------------

STOP = "[" + ", ".join(map(text, L.STOP_WORDS)) + "]"


def _tokens(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({sub(c, (L.COMMAND, ' '), ('[{}]', ' '))}), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains({STOP}, t)))"


POSTINGS = f"postings AS (SELECT unnest({_tokens('text')}) AS token, doc_id AS id, 'statement' AS field, 3.0::DOUBLE AS weight FROM documents UNION ALL SELECT unnest({_tokens('source')}), doc_id, 'type', 1.0::DOUBLE FROM documents)"
QUERY = "ingre hation shble src3 the nothingsuch"
Q = f"q AS (SELECT unnest({_tokens(text(QUERY))}) AS token)"
TEXT_HITS = f"hits AS (SELECT id, least(sum(idf * weight) / (SELECT count(*) FROM q), 1) AS score FROM (SELECT p.*, (SELECT count(*) FROM documents)::DOUBLE / count(*) OVER (PARTITION BY p.token) AS idf FROM postings p JOIN q ON p.token = q.token) GROUP BY id)"


def _postings(spark, d):
    return search.text_postings(table(spark, d, "documents"), {"statement": "text", "type": "source"}, "doc_id")


@query("token_postings", cte(POSTINGS) + "SELECT token, field, count(*) AS n, min(id) AS first, max(id) AS last, any_value(weight) AS weight FROM postings GROUP BY token, field")
def token_postings(spark, d):
    return _postings(spark, d).groupBy("token", "field").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.any_value("weight").alias("weight"))


@query("text_search", cte(POSTINGS, Q, TEXT_HITS) + f"SELECT id, {r('score')} AS score FROM hits")
def text_search(spark, d):
    return _rounded(search.text_search(_postings(spark, d), table(spark, d, "documents").count(), QUERY).select("id", "score"), "score")


def _jac(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct({a} || {b})), 0)::DOUBLE, 0)"


WORDS = "['small', 'ring', 'bolt']"
FUZZY = f"fuzzy AS (SELECT p_partkey AS id, greatest({_jac(WORDS, 'list_distinct(string_split(lower(p_name), chr(32)))')}, {_jac(WORDS, 'list_distinct(string_split(lower(p_type), chr(32)))')}) AS score FROM part)"


@query("fuzzy_search", cte(FUZZY) + f"SELECT id, {r('score')} AS score FROM fuzzy WHERE score >= 0.6")
def fuzzy_search(spark, d):
    return _rounded(search.fuzzy_search(table(spark, d, "part"), "Small ring bolt", ["p_name", "p_type"], 0.6, "p_partkey"), "score")


@query("search_merge", cte(T, FUZZY) + f"""SELECT id, {r("max(score)")} AS score, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM (SELECT id, score, 'fuzzy' AS kind FROM fuzzy WHERE score >= 0.6 UNION ALL SELECT id, 0.95::DOUBLE, 'type' FROM theorems WHERE theorem_type = 'trigonometric'
 UNION ALL SELECT id, 0.9::DOUBLE, 'symbol' FROM theorems WHERE list_contains(symbols, 'gear') UNION ALL SELECT id, 0.7::DOUBLE, 'transformation' FROM theorems WHERE len(list_filter(chain, lambda c: contains(lower(c), 'eco'))) > 0 UNION ALL SELECT id, 0.8::DOUBLE, 'status' FROM theorems WHERE validated) GROUP BY id ORDER BY score DESC, id LIMIT 50""")
def search_merge(spark, d):
    t = corpus.theorems(spark, d)
    hit = lambda cond, kind: t.filter(cond).select("id", F.lit(search.SCORES[kind]).alias("score"), F.lit(kind).alias("kind"))
    fuzzy = search.fuzzy_search(table(spark, d, "part"), "Small ring bolt", ["p_name", "p_type"], 0.6, "p_partkey").withColumn("kind", F.lit("fuzzy"))
    found = search.merge_results(
        fuzzy, hit(F.col("theorem_type") == "trigonometric", "type"), hit(F.array_contains("symbols", "gear"), "symbol"), hit(F.exists("chain", lambda c: F.lower(c).contains("eco")), "transformation"), hit(F.col("validated"), "status")
    )
    top = search.top(_rounded(found, "score"), 50, F.desc("score"), "id")
    return top.withColumn("kinds", F.array_join("kinds", ","))


@query("search_filters", cte(T) + "SELECT id, theorem_type FROM theorems WHERE theorem_type IN ('trigonometric', 'logarithmic', 'exponential') AND confidence BETWEEN 0.2 AND 0.8 AND list_has_any(symbols, ['ring', 'bolt']) AND list_has_any(chain, ['SMALL', 'ECONOMY'])")
def search_filters(spark, d):
    f = search.Filters(types=["trigonometric", "logarithmic", "exponential"], confidence=(0.2, 0.8), symbols=["ring", "bolt"], methods=["SMALL", "ECONOMY"])
    return search.apply_filters(corpus.theorems(spark, d), f).select("id", "theorem_type")


@query("table_filters_or", cte(T) + "SELECT id FROM theorems WHERE theorem_type IN ('generalization') OR confidence >= 0.9 OR list_has_any(symbols, ['gear'])")
def table_filters_or(spark, d):
    f = search.Filters(types=["generalization"], least=0.9, symbols=["gear"])
    return search.apply_filters(corpus.theorems(spark, d), f, mode="or").select("id")


@query("table_page", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def table_page(spark, d):
    rows, _ = search.page(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), 3, 25, "o_orderpriority", F.desc("o_totalprice"), "o_orderkey")
    return rows


@query("top_importance", cte(T) + f"SELECT id, {r('CASE WHEN validated THEN 10 ELSE 0 END + confidence * 5')} AS importance FROM theorems ORDER BY importance DESC, id LIMIT 100")
def top_importance(spark, d):
    t = corpus.theorems(spark, d)
    return search.top(t.select("id", F.round(B.importance(F.col("confidence"), F.col("validated"), F.col("statement")), S).alias("importance")), 100, F.desc("importance"), "id")


@query("facets", cte(T) + "SELECT facet, value, count(*) AS n FROM (SELECT 'type' AS facet, theorem_type AS value FROM theorems UNION ALL SELECT 'source', source FROM theorems UNION ALL SELECT 'symbol', unnest(symbols) FROM theorems UNION ALL SELECT 'method', unnest(chain) FROM theorems) GROUP BY facet, value")
def facets(spark, d):
    values = {"type": F.array("theorem_type"), "source": F.array("source"), "symbol": F.col("symbols"), "method": F.col("chain")}
    return search.metadata_postings(corpus.theorems(spark, d), values).groupBy(F.col("key").alias("facet"), "value").agg(F.count(F.lit(1)).alias("n"))


@query("symbol_postings", cte(T) + """SELECT token, count(*) AS n FROM (SELECT id, unnest(list_distinct(list_transform(symbols || regexp_extract_all(statement, '([a-zA-Z])_\\{([^}]+)\\}', 1), lambda s: lower(s)))) AS token FROM theorems) GROUP BY token""")
def symbol_postings(spark, d):
    return search.symbol_postings(corpus.theorems(spark, d), "symbols", "statement").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("index_upsert", cte(POSTINGS) + "SELECT field, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT token, id, field FROM postings WHERE id NOT IN (SELECT doc_id FROM documents WHERE lang = 'es') UNION ALL SELECT unnest(['new', 'tokens', 'here']), doc_id, 'statement' FROM documents WHERE lang = 'es') GROUP BY field")
def index_upsert(spark, d):
    new = table(spark, d, "documents").filter("lang = 'es'").withColumn("text", F.lit("new tokens here"))  # the rows that change
    index = search.upsert(_postings(spark, d), search.text_postings(new, {"statement": "text"}, "doc_id"))
    return index.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("substring_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_type, p_brand)), 'ing eco')")
def substring_search(spark, d):
    return table(spark, d, "part").filter(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")).contains("ing eco")).select("p_partkey", "p_name")


@query("semi_anti_ids", "SELECT w.doc_id, d.doc_id IS NOT NULL AS found FROM (SELECT DISTINCT doc_id * 3 AS doc_id FROM labels) w LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON w.doc_id = d.doc_id")
def semi_anti_ids(spark, d):
    wanted, docs = table(spark, d, "labels").select((F.col("doc_id") * 3).alias("doc_id")).distinct(), table(spark, d, "documents").select("doc_id")
    return wanted.join(docs, "doc_id", "left_semi").withColumn("found", F.lit(True)).unionByName(wanted.join(docs, "doc_id", "left_anti").withColumn("found", F.lit(False)))


# -- graphs --------------------------------------------------------------------------------------------

CHAIN_EDGES = "edges AS (SELECT p_partkey AS src, p_partkey - p_partkey % 16 + p_size % 16 AS dst FROM part)"
MESH = "mesh AS (SELECT * FROM (SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_size % 3 <> 0 AND p_partkey % 16 <> 15 UNION SELECT p_partkey, p_partkey + 2 FROM part WHERE p_size % 2 = 0 AND p_partkey % 16 < 14) WHERE dst IN (SELECT p_partkey FROM part))"


def _chain_edges(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("src"), (k - k % 16 + F.col("p_size") % 16).alias("dst"))


def _mesh(spark, d):
    t = table(spark, d, "part")
    one = t.filter("p_size % 3 <> 0 AND p_partkey % 16 <> 15").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"))
    return one.unionByName(t.filter("p_size % 2 = 0 AND p_partkey % 16 < 14").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 2).alias("dst"))).distinct()


def _reach(edges: str) -> str:
    return f"both_ AS (SELECT src, dst FROM {edges} UNION SELECT dst, src FROM {edges}), reach AS (SELECT src AS node, src AS other FROM both_ UNION SELECT r.node, b.dst FROM reach r JOIN both_ b ON r.other = b.src), comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"


@query("components", f"WITH RECURSIVE {CHAIN_EDGES}, {_reach('edges')} SELECT node, component FROM comp")
def components(spark, d):
    return graph.components(_chain_edges(spark, d), cut)


@query("neighborhood", f"""WITH {CHAIN_EDGES}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), h0 AS (SELECT unnest([5, 50, 100]) AS node), h1 AS (SELECT DISTINCT dst AS node FROM b JOIN h0 ON src = node), h2 AS (SELECT DISTINCT dst AS node FROM b JOIN h1 ON src = node)
 SELECT node, min(hops)::INTEGER AS hops FROM (SELECT node, 0 AS hops FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node""")
def neighborhood(spark, d):
    return graph.neighborhood(_chain_edges(spark, d), [5, 50, 100], 2)


@query("graph_stats", f"""WITH RECURSIVE {MESH}, {_reach('mesh')}, deg AS (SELECT p_partkey AS node, count(b.dst) AS degree FROM part LEFT JOIN both_ b ON p_partkey = b.src GROUP BY 1),
 tri AS (SELECT a.src AS node, count(*) / 2 AS t FROM both_ a JOIN both_ b ON a.dst = b.src JOIN both_ c ON b.dst = c.src AND c.dst = a.src GROUP BY 1), sizes AS (SELECT component, count(*) AS n FROM comp GROUP BY 1)
 SELECT n AS nodes, m AS edges, {r("2.0::DOUBLE * m / (n * (n - 1))")} AS density, {r("2.0::DOUBLE * m / n")} AS average_degree, (SELECT count(*) FROM sizes) + n - (SELECT count(*) FROM comp) AS components, (SELECT max(n) FROM sizes) AS largest, {r("c")} AS clustering FROM
 (SELECT count(*) AS n, (sum(degree) / 2)::BIGINT AS m, avg(CASE WHEN degree >= 2 THEN 2.0::DOUBLE * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END) AS c FROM deg LEFT JOIN tri ON deg.node = tri.node)""")
def graph_stats(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    inside = _mesh(spark, d).join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    return _rounded(graph.statistics(inside, nodes, cut), "density", "average_degree", "clustering")


@query("symbol_edges", cte(T) + "SELECT id AS src, 'SYM_' || symbol AS dst, 'contains_symbol' AS edge_type, 1.0::DOUBLE AS weight FROM (SELECT DISTINCT id, unnest(symbols) AS symbol FROM theorems) WHERE symbol IN (SELECT symbol FROM (SELECT DISTINCT id, unnest(symbols) AS symbol FROM theorems) GROUP BY symbol HAVING count(*) >= 2)")
def symbol_edges(spark, d):
    return graph.symbol_edges(corpus.theorems(spark, d))


@query("type_links", cte(T) + "SELECT id AS src, first AS dst, 'same_type' AS edge_type, 0.8::DOUBLE AS weight, n FROM (SELECT id, min(id) OVER (PARTITION BY theorem_type) AS first, count(*) OVER (PARTITION BY theorem_type) AS n FROM theorems) WHERE id <> first")
def type_links(spark, d):
    return graph.group_links(corpus.theorems(spark, d), "theorem_type", "same_type", graph.TYPE_WEIGHT)


@query("source_links", cte(T) + "SELECT id AS src, first AS dst, 'same_source' AS edge_type, 1.0::DOUBLE AS weight, n FROM (SELECT id, min(id) OVER (PARTITION BY source) AS first, count(*) OVER (PARTITION BY source) AS n FROM theorems) WHERE id <> first")
def source_links(spark, d):
    return graph.group_links(corpus.theorems(spark, d), "source", "same_source", graph.SOURCE_WEIGHT)


SETS = "sets AS (SELECT min(p_partkey) AS class, list_sort(list_distinct(string_split(p_name, ' ') || [p_type])) AS s FROM part GROUP BY 2)"


def _named_sets(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.split("p_name", " "), F.array("p_type")).alias("symbols"))


@query("overlap_edges", cte(SETS) + f"SELECT a.class AS src, b.class AS dst, {r(_jac('a.s', 'b.s'))} AS weight FROM sets a JOIN sets b ON a.class < b.class WHERE {_jac('a.s', 'b.s')} > 0.4")
def overlap_edges(spark, d):
    edges, _ = graph.overlap_edges(_named_sets(spark, d))
    return _rounded(edges, "weight")


@query("overlap_members", "SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY s) AS class, count(*) OVER (PARTITION BY s) AS n FROM (SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' ') || [p_type])) AS s FROM part)")
def overlap_members(spark, d):
    return graph.overlap_edges(_named_sets(spark, d))[1]


CHAINS = "chains AS (SELECT min(p_partkey) AS class, string_split(p_name, ' ') || [p_type] AS s FROM part GROUP BY 2)"
CHAIN_SCORE = f"least({_jac('a.s', 'b.s')} + CASE WHEN len(a.s) = len(b.s) THEN len(list_filter(list_transform(range(1, len(a.s) + 1), lambda i: a.s[i] = b.s[i]), lambda x: x)) / len(a.s)::DOUBLE * 0.3 ELSE 0 END, 1)"


@query("chain_edges", cte(CHAINS) + f"SELECT src, dst, {r('w')} AS weight FROM (SELECT a.class AS src, b.class AS dst, {CHAIN_SCORE} AS w FROM chains a JOIN chains b ON a.class < b.class) WHERE w > 0.5")
def chain_edges(spark, d):
    edges, _ = graph.chain_edges(_named_sets(spark, d), "symbols")
    return _rounded(edges, "weight")


@query("type_subgraph", cte(T, CHAIN_EDGES) + "SELECT src, dst FROM edges WHERE src IN (SELECT id FROM theorems WHERE theorem_type IN ('trigonometric', 'logarithmic', 'exponential')) AND dst IN (SELECT id FROM theorems WHERE theorem_type IN ('trigonometric', 'logarithmic', 'exponential'))")
def type_subgraph(spark, d):
    nodes = corpus.theorems(spark, d).filter(F.col("theorem_type").isin("trigonometric", "logarithmic", "exponential")).select(F.col("id").alias("node"))
    return graph.subgraph(_chain_edges(spark, d), nodes).select("src", "dst")


@query("circular_layout", f"SELECT node, {r('cos(a)')} AS x, {r('sin(a)')} AS y FROM (SELECT p_partkey AS node, 2 * pi() * (row_number() OVER (ORDER BY p_partkey) - 1) / count(*) OVER () AS a FROM part)")
def circular_layout(spark, d):
    return _rounded(graph.positions(table(spark, d, "part").select(F.col("p_partkey").alias("node"))), "x", "y")


# -- strategies ------------------------------------------------------------------------------------------

ADDED = {
    "symbolic": "CASE WHEN c < 0.4 THEN 0.3 WHEN c > 0.8 THEN -0.4 ELSE 0 END + CASE WHEN algebraic AND NOT trigonometric AND NOT logarithmic AND NOT exponential THEN 0.2 ELSE 0 END - CASE WHEN trigonometric THEN 0.2 ELSE 0 END + CASE WHEN k = 'algebraic_identity' THEN 0.2 ELSE 0 END",
    "rule_based": "CASE WHEN c BETWEEN 0.4 AND 0.6 THEN 0.2 ELSE 0 END + CASE WHEN algebraic THEN 0.3 ELSE 0 END + CASE WHEN trigonometric THEN 0.25 ELSE 0 END + CASE k WHEN 'algebraic_identity' THEN 0.15 WHEN 'trigonometric' THEN 0.25 ELSE 0 END",
    "formal": "CASE WHEN k IN ('algebraic_identity', 'trigonometric') THEN 0.2 ELSE 0 END + CASE WHEN c > 0.6 THEN 0.15 ELSE 0 END - CASE WHEN c < 0.2 THEN 0.3 ELSE 0 END + CASE WHEN k = 'trigonometric' THEN 0.2 ELSE 0 END",
    "hybrid_sr": "CASE WHEN algebraic AND c >= 0.4 THEN 0.25 ELSE 0 END + 0.1 - CASE WHEN k = 'functional_equation' THEN 0.1 ELSE 0 END",
    "hybrid_sf": "CASE WHEN c > 0.6 THEN 0.2 ELSE 0 END + CASE WHEN k IN ('algebraic_identity', 'trigonometric', 'functional_equation') THEN 0.15 ELSE 0 END + CASE WHEN k = 'functional_equation' THEN 0.3 ELSE 0 END",
    "comprehensive": "CASE WHEN c > 0.8 THEN 0.1 WHEN c < 0.4 THEN -0.2 ELSE 0 END + CASE WHEN k IN ('functional_equation', 'generalization') THEN 0.15 ELSE 0 END + CASE WHEN k = 'functional_equation' THEN 0.3 ELSE 0 END",
}
SCORES = "scores AS (" + " UNION ALL ".join(f"SELECT id, '{s}' AS strategy, {i}::INTEGER AS ordinal, round(greatest(0, least(1, {strategy.BASE[s]}::DOUBLE + ({a})::DOUBLE)), {S}) AS score FROM (SELECT *, round(complexity, {S}) AS c, theorem_type AS k FROM traits)" for i, (s, a) in enumerate(ADDED.items())) + ")"


def _scores(spark, d):
    t = _traits(spark, d).withColumn("complexity", F.round("complexity", S))
    return _rounded(strategy.score_strategies(t), "score")


@query("strategy_scores", cte(T, CHARACTER, SCORES) + "SELECT id, strategy, ordinal, score FROM scores")
def strategy_scores(spark, d):
    return _scores(spark, d)


@query("best_strategy", cte(T, CHARACTER, SCORES) + "SELECT id, strategy, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ordinal) AS r FROM scores) WHERE r = 1")
def best_strategy(spark, d):
    return strategy.best_strategy(_scores(spark, d))


@query("auto_select", cte(T, CHARACTER) + "SELECT id, CASE WHEN theorem_type = 'algebraic_identity' AND string_complexity < 0.3 THEN 'symbolic' WHEN string_complexity > 0.7 THEN 'hybrid_sr' WHEN theorem_type = 'functional_equation' THEN 'comprehensive' ELSE 'hybrid_sr' END AS strategy FROM traits")
def auto_select(spark, d):
    return _traits(spark, d).select("id", strategy.auto_select(F.col("theorem_type"), F.col("string_complexity")).alias("strategy"))


NAMES = list(strategy.BASE)
RESULTS = f"results AS (SELECT l_orderkey AS id, [{', '.join(map(text, NAMES))}][l_linenumber % 6 + 1] AS strategy, l_returnflag <> 'R' AS success, least(1, l_discount * 10 + l_linenumber * 0.001::DOUBLE) AS confidence, l_quantity AS seconds FROM lineitem)"


def _results(spark, d):
    t = table(spark, d, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("id"), F.element_at(F.array(*(F.lit(x) for x in NAMES)), (F.col("l_linenumber") % 6 + 1).cast("int")).alias("strategy"), (F.col("l_returnflag") != "R").alias("success"),
        F.least(F.lit(1.0), F.col("l_discount") * 10 + F.col("l_linenumber") * 0.001).alias("confidence"), F.col("l_quantity").alias("seconds"),
    )


WEIGHT = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in strategy.INTEGRATION.items()) + "}"


ORDER = "['symbolic', 'rule_based', 'formal', 'hybrid_sr', 'hybrid_sf', 'comprehensive']"


@query("integrate_results", cte(RESULTS) + f"""SELECT id, methods, successes, {r("mean_confidence")} AS mean_confidence, round(variance + 1e-9, 6) AS variance, best, worst, seconds, round(integrated + 1e-9, 6) AS integrated, final_status, convergent,
 CASE WHEN round(integrated, 9) >= 0.8 THEN 'very_high' WHEN round(integrated, 9) >= 0.6 THEN 'high' WHEN round(integrated, 9) >= 0.4 THEN 'medium' WHEN round(integrated, 9) >= 0.2 THEN 'low' ELSE 'very_low' END AS level FROM (SELECT *,
 greatest(0, least(1, weighted + CASE WHEN successes >= 2 THEN least(0.1::DOUBLE, (successes - 1) * 0.05) ELSE 0 END - CASE WHEN successes > 0 AND conflicts > 0 THEN least(0.1::DOUBLE, conflicts * 0.03) ELSE 0 END)) AS integrated,
 CASE WHEN successes = 0 THEN 'failed' WHEN strong > 0 OR moderate >= 2 OR moderate = 1 AND top > 0.6 THEN 'proved' ELSE 'partially_proved' END AS final_status, methods >= 2 AND (successes >= methods * 0.6 OR methods - successes >= methods * 0.6) AS convergent
 FROM (SELECT id, count(*) AS methods, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success AND confidence > 0.3) AS conflicts, count(*) FILTER (success AND confidence > 0.7) AS strong, count(*) FILTER (success AND confidence > 0.4) AS moderate,
 max(confidence) FILTER (success) AS top, sum(confidence * {WEIGHT}[strategy]) / sum({WEIGHT}[strategy]) AS weighted, avg(confidence) AS mean_confidence, var_pop(confidence) AS variance, sum(seconds) AS seconds,
 (list(strategy ORDER BY confidence DESC, list_position({ORDER}, strategy)))[1] AS best, (list(strategy ORDER BY confidence, list_position({ORDER}, strategy)))[1] AS worst FROM results GROUP BY id))""")
def integrate_results(spark, d):
    t = strategy.integrate(_results(spark, d)).withColumn("level", B.integrated_level(F.round("integrated", 9)))
    return _rounded(t.withColumns({c: F.col(c) + 1e-9 for c in ("variance", "integrated")}), "mean_confidence", "variance", "integrated")  # off the rounding ties


@query("method_performance", cte(RESULTS) + f"SELECT strategy, count(*) AS attempts, count(*) FILTER (success) AS successes, {r('avg(success::INT)')} AS success_rate, {r('avg(confidence)')} AS mean_confidence, {r('avg(seconds)')} AS mean_time FROM results GROUP BY strategy")
def method_performance(spark, d):
    return _rounded(strategy.performance(_results(spark, d)), "success_rate", "mean_confidence", "mean_time")


METHODS = ["direct", "simplify", "algebraic", "substitution", "solver", "pattern", "numeric"]
ATTEMPTS = f"attempts AS (SELECT l_orderkey AS id, [{', '.join(map(text, METHODS))}][l_linenumber] AS method, l_linenumber AS o, CASE WHEN l_quantity > 45 THEN 'proved' WHEN l_quantity < 3 THEN 'disproved' ELSE 'unknown' END AS status, l_discount AS confidence FROM lineitem WHERE l_linenumber <= 7)"


@query("first_result", cte(ATTEMPTS) + """SELECT id, method, status, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY status = 'unknown', CASE WHEN status = 'unknown' THEN -confidence ELSE o END, o, status, confidence) AS r FROM attempts) WHERE r = 1""")
def first_result(spark, d):
    t = table(spark, d, "lineitem").filter("l_linenumber <= 7")  # the seven methods
    q = F.col("l_quantity")
    t = t.select(F.col("l_orderkey").alias("id"), F.element_at(F.array(*(F.lit(m) for m in METHODS)), F.col("l_linenumber").cast("int")).alias("method"), F.when(q > 45, "proved").when(q < 3, "disproved").otherwise("unknown").alias("status"), F.col("l_discount").alias("confidence"))
    return strategy.first_result(t, METHODS)


# -- discovery -----------------------------------------------------------------------------------------------


@query("concept_groups", "SELECT p_name AS concept, count(*) AS n, count(DISTINCT p_brand) AS formulas, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS topics FROM part GROUP BY p_name")
def concept_groups(spark, d):
    t = table(spark, d, "part").select(F.col("p_name").alias("concept"), F.col("p_brand").alias("formula"), F.col("p_type").alias("topic"))
    return discover.concepts(t).withColumn("topics", F.array_join("topics", ","))


@query("sparse_concepts", cte(CHAIN_EDGES) + f"""SELECT node, degree, {r("least(1, 0.5::DOUBLE + CASE WHEN p_size > 10 THEN 0.2 ELSE 0 END + 0.1)")} AS priority FROM (SELECT p_partkey AS node, any_value(p_size) AS p_size, count(e.node) AS degree FROM part LEFT JOIN (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) e ON e.node = p_partkey GROUP BY 1) WHERE degree < 2""")
def sparse_concepts(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") > 10, 2).otherwise(1).alias("n"), F.array("p_type").alias("topics"))
    return _rounded(discover.sparse_concepts(nodes, _chain_edges(spark, d)).select("node", "degree", "priority"), "priority")


@query("domain_gaps", f"SELECT lang, n, {r('mean')} AS mean FROM (SELECT lang, n, avg(n) OVER () AS mean FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)) WHERE n < 0.5 * mean")
def domain_gaps(spark, d):
    return _rounded(discover.domain_gaps(table(spark, d, "documents"), "lang"), "mean")


@query("neighbor_pairs", cte(T, "o AS (SELECT theorem_type, id, statement, list_sort(list_distinct(symbols)) AS s, row_number() OVER (PARTITION BY theorem_type ORDER BY id) AS i FROM theorems)") + """SELECT theorem_type, a, b FROM (SELECT *, row_number() OVER (PARTITION BY theorem_type ORDER BY i, j) AS n FROM
 (SELECT x.theorem_type, x.id AS a, y.id AS b, x.i, y.i AS j FROM o x JOIN o y ON x.theorem_type = y.theorem_type AND y.i BETWEEN x.i + 1 AND x.i + 4 WHERE x.i <= 10 AND x.statement <> y.statement AND x.s = y.s AND len(x.s) > 0)) WHERE n <= 5""")
def neighbor_pairs(spark, d):
    return discover.neighbor_pairs(corpus.theorems(spark, d), "theorem_type", "id", "statement", same="symbols")


TOPICS = [t for g in discover.TOPIC_GROUPS for t in g[:2]]
NODE_TOPICS = f"[{', '.join(map(text, TOPICS))}][n_nationkey % {len(TOPICS)} + 1]"
GROUP_OF = "MAP {" + ", ".join(f"{text(t)}: 'group {i}'" for i, g in enumerate(discover.TOPIC_GROUPS) for t in g) + "}"


@query("disconnected_gaps", f"""WITH RECURSIVE links AS (SELECT n_nationkey AS src, n_nationkey + 7 AS dst FROM nation WHERE n_nationkey < 12), {_reach("links")}, named AS (SELECT n_nationkey, coalesce(component, n_nationkey) AS c, {NODE_TOPICS} AS topic FROM nation LEFT JOIN comp ON node = n_nationkey),
 keys AS (SELECT c, topic AS k FROM named UNION SELECT c, {GROUP_OF}[topic] FROM named), sets AS (SELECT c, list_sort(list(k)) AS ks FROM keys GROUP BY c), cls AS (SELECT min(c) AS c, count(*) AS n, ks FROM sets GROUP BY ks)
 SELECT x.c AS a, y.c AS b, x.n AS a_components, y.n AS b_components, array_to_string(list_sort(list_intersect(x.ks, y.ks)), ',') AS shared FROM cls x JOIN cls y ON x.c < y.c AND list_has_any(x.ks, y.ks)""")
def disconnected_gaps(spark, d):
    t = table(spark, d, "nation")
    nodes = t.select(F.col("n_nationkey").alias("node"), F.array(F.element_at(F.array(*(F.lit(x) for x in TOPICS)), F.col("n_nationkey") % len(TOPICS) + 1)).alias("topics"))
    edges = t.filter("n_nationkey < 12").select(F.col("n_nationkey").alias("src"), (F.col("n_nationkey") + 7).alias("dst"))
    pairs, members = discover.related_components(nodes, edges, cut)
    sizes = members.select("class", "n").distinct()
    out = pairs.join(sizes.withColumnsRenamed({"class": "a", "n": "a_components"}), "a").join(sizes.withColumnsRenamed({"class": "b", "n": "b_components"}), "b")
    return out.select("a", "b", "a_components", "b_components", F.array_join("shared", ",").alias("shared"))


GAPS = "gaps AS (SELECT p_partkey AS ordinal, ['sparse', 'disconnected', 'variation', 'transformation', 'domain'][p_partkey % 5 + 1] AS kind, [0.8, 0.7, 0.6, 0.5, 0.4][p_partkey % 5 + 1]::DOUBLE AS confidence, (p_size % 11) / 10.0::DOUBLE AS priority FROM part)"


@query("rank_gaps", cte(GAPS) + f"SELECT ordinal, kind, {r('confidence * 0.6 + priority * 0.4')} AS rank_score FROM gaps ORDER BY rank_score DESC, ordinal LIMIT 50")
def rank_gaps(spark, d):
    kinds = list(discover.GAP_SCORES)
    i = (F.col("p_partkey") % 5 + 1).cast("int")
    t = table(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), F.element_at(F.array(*(F.lit(k) for k in kinds)), i).alias("kind"), F.element_at(F.array(*(F.lit(discover.GAP_SCORES[k][0]) for k in kinds)), i).alias("confidence"), (F.col("p_size") % 11 / 10.0).alias("priority"))
    ranked = _rounded(discover.rank_gaps(t), "rank_score")
    return search.top(ranked, 50, F.desc("rank_score"), "ordinal").select("ordinal", "kind", "rank_score")


BONUS = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in discover.TYPE_BONUS.items()) + "}"
KINDS = [*discover.TYPE_BONUS, "other"]


@query("rank_hypotheses", f"SELECT p_partkey AS id, kind, {r(f'least(1, (p_size % 10) / 12.0::DOUBLE + coalesce({BONUS}[kind], 0) + CASE WHEN p_size % 3 > 1 THEN 0.1 ELSE 0 END)')} AS rank FROM (SELECT *, [{', '.join(map(text, KINDS))}][p_partkey % {len(KINDS)} + 1] AS kind FROM part)")
def rank_hypotheses(spark, d):
    t = table(spark, d, "part").withColumn("kind", F.element_at(F.array(*(F.lit(k) for k in KINDS)), (F.col("p_partkey") % len(KINDS) + 1).cast("int")))
    return t.select(F.col("p_partkey").alias("id"), "kind", F.round(discover.hypothesis_rank(F.col("p_size") % 10 / 12.0, F.col("kind"), F.col("p_size") % 3), S).alias("rank"))


# -- similarity ------------------------------------------------------------------------------------------------

PRINTS = "prints AS (SELECT p_partkey AS id, p_type AS hash, list_sort(list_distinct(string_split(p_name, ' '))) AS symbols, list_sort(list_distinct([p_type, substring(p_name, 1, 1)])) AS operations, CASE WHEN p_size % 3 = 0 THEN [] ELSE ['f' || (p_size % 3)] END AS functions, p_size % 3 AS complexity FROM part)"
CLASSES = "classes AS (SELECT min(id) AS class, count(*) AS n, hash, symbols, operations, functions, complexity FROM prints GROUP BY ALL)"
SIM = f"CASE WHEN a.hash = b.hash THEN 0.3::DOUBLE ELSE 0 END + 0.25 * {_jac('a.symbols', 'b.symbols')} + 0.25 * {_jac('a.operations', 'b.operations')} + 0.1 * {_jac('a.functions', 'b.functions')} + 0.1 * CASE WHEN greatest(a.complexity, b.complexity) > 0 THEN 1 - abs(a.complexity - b.complexity) / greatest(a.complexity, b.complexity)::DOUBLE ELSE 1 END"


def _prints(spark, d):
    t = table(spark, d, "part")
    n = F.col("p_size") % 3
    return t.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("hash"), F.split("p_name", " ").alias("symbols"), F.array("p_type", F.left("p_name", F.lit(1))).alias("operations"), F.when(n == 0, F.expr("CAST(array() AS array<string>)")).otherwise(F.array(F.concat(F.lit("f"), n.cast("string")))).alias("functions"), n.alias("complexity"))


@query("fingerprint_similarity", cte(PRINTS, CLASSES) + f"SELECT a.class AS src, b.class AS dst, {r(SIM)} AS weight FROM classes a JOIN classes b ON a.class < b.class WHERE round({SIM}, 9) >= 0.7")
def fingerprint_similarity(spark, d):
    return _rounded(cluster.similar_fingerprints(_prints(spark, d), 0.7)[0], "weight")


def density_sql(least: int) -> str:
    """Clusters by density from ``links`` (src, dst) and ``sizes`` (class, n): linked cores, and what is beside a core."""
    return f"""ends AS (SELECT src, dst FROM links UNION ALL SELECT dst, src FROM links), core AS (SELECT class FROM sizes LEFT JOIN (SELECT src, sum(n) AS k FROM ends JOIN sizes ON class = dst GROUP BY 1) ON src = class WHERE n + coalesce(k, 0) >= {least}),
 reach AS (SELECT class AS node, class AS other FROM core UNION SELECT r.node, e.dst FROM reach r JOIN ends e ON e.src = r.other JOIN core ON core.class = e.dst), own AS (SELECT node AS class, min(other) AS cluster FROM reach GROUP BY 1),
 found AS (SELECT * FROM own UNION ALL SELECT e.src, min(o.cluster) FROM ends e JOIN own o ON o.class = e.dst WHERE e.src NOT IN (SELECT class FROM core) GROUP BY 1)"""


@query("density_clusters", f"""WITH RECURSIVE {PRINTS}, {CLASSES}, links AS (SELECT a.class AS src, b.class AS dst FROM classes a JOIN classes b ON a.class < b.class WHERE round({SIM}, 9) >= 0.9), sizes AS (SELECT class, n FROM classes), {density_sql(2)}
 SELECT p.id, class, cluster FROM prints p JOIN classes c ON p.hash = c.hash AND p.symbols = c.symbols AND p.operations = c.operations AND p.functions = c.functions AND p.complexity = c.complexity JOIN found USING (class)""")
def density_clusters(spark, d):
    links, members = cluster.similar_fingerprints(_prints(spark, d), 0.9)
    found = cluster.density_clusters(cut(links), cut(members), cut)
    return members.join(found, "class").select("id", "class", "cluster")


@query("cluster_summary", cte(PRINTS, "c AS (SELECT p_partkey AS id, p_brand || ' ' || p_type AS cluster FROM part)", "b AS (SELECT * FROM prints JOIN c USING (id))", "s AS (SELECT cluster, count(*) AS size, avg(complexity) AS mc, min(complexity) AS lc, max(complexity) AS xc FROM b GROUP BY 1)") + f"""SELECT s.cluster, size, {r("mc")} AS mean_complexity, lc AS least_complexity, xc AS most_complexity,
 {", ".join(f"(SELECT coalesce(array_to_string(list_sort(list(t)), ','), '') FROM (SELECT t, count(*) AS k FROM (SELECT id, unnest({c}) AS t FROM b WHERE b.cluster = s.cluster) GROUP BY t) WHERE k = size) AS common_{c}" for c in ("symbols", "operations", "functions"))} FROM s""")
def cluster_summary(spark, d):
    own = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_type").alias("cluster"))
    t = cluster.summarize(_prints(spark, d), own)
    return _rounded(t.select("cluster", "size", "mean_complexity", "least_complexity", "most_complexity", *(F.coalesce(F.array_join(f"common_{c}", ","), F.lit("")).alias(f"common_{c}") for c in ("symbols", "operations", "functions"))), "mean_complexity")


@query("cosine_matrix", f"SELECT q.vec_id AS query, v.vec_id AS id, {r('list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])')} AS cosine FROM embeddings q, embeddings v")
def cosine_matrix(spark, d):
    return _rounded(cluster.cosines(table(spark, d, "embeddings")), "cosine")


@query("cluster_sizes", "SELECT label, count(*) AS n, array_to_string(list_sort(list(vec_id))[1:3], ',') AS first, label = -1 AS noise FROM embeddings GROUP BY label")
def cluster_sizes(spark, d):
    t = cluster.cluster_sizes(table(spark, d, "embeddings"), "label", "vec_id")
    return t.withColumn("first", F.array_join(F.transform("first", lambda x: x.cast("string")), ","))


BRANDS = "c AS (SELECT class, n, hash, symbols, operations, functions, complexity, 'c' || (class % 40) AS cluster FROM classes)"


@query("cluster_confidence", cte(PRINTS, CLASSES, BRANDS, f"""each_ AS (SELECT a.cluster, a.class, a.n, max((a.n - 1) * ({SIM.replace("b.", "a.")})) + coalesce(sum(CASE WHEN a.class <> b.class THEN b.n * ({SIM}) ELSE 0 END), 0) AS total FROM c a JOIN c b ON a.cluster = b.cluster GROUP BY a.cluster, a.class, a.n)""") + f"""SELECT cluster,
 {r("CASE WHEN sum(n) < 2 THEN 1 ELSE sum(total * n) / (sum(n) * (sum(n) - 1.0)) END")} AS confidence, (list(class ORDER BY round(total, 9) DESC, class))[1] AS center FROM each_ GROUP BY cluster""")
def cluster_confidence(spark, d):
    classes = cut(cluster.fingerprint_classes(_prints(spark, d)))
    named = classes.select("class", F.concat(F.lit("c"), (F.col("class") % 40).cast("string")).alias("cluster"))
    return _rounded(cluster.confidence_and_center(classes.select(F.col("class").alias("id"), "f.*"), classes, named), "confidence")
