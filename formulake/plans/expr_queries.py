"""Queries on expressions, rules and proofs. Most have no SQL form; tests hold them against known results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expressions as X
from ..operators import strategy, validation
from ..sources import rules as R
from . import corpus
from .registry import cte, query, table, text

# Literals of the survey's inventory, apart from the engine's own table: id, kind, pattern, replacement, priority, both ways.
RULE_ROWS = """rules AS (SELECT id, id AS name, * EXCLUDE (id) FROM (VALUES
 ('square_of_sum', 'algebraic', '(a + b)**2', 'a**2 + 2*a*b + b**2', 4, true), ('square_of_difference', 'algebraic', '(a - b)**2', 'a**2 - 2*a*b + b**2', 4, true), ('difference_of_squares', 'algebraic', 'a**2 - b**2', '(a + b)*(a - b)', 4, true),
 ('perfect_square_trinomial_positive', 'algebraic', 'a**2 + 2*a*b + b**2', '(a + b)**2', 3, true), ('perfect_square_trinomial_negative', 'algebraic', 'a**2 - 2*a*b + b**2', '(a - b)**2', 3, true),
 ('distributive_property', 'algebraic', 'a*(b + c)', 'a*b + a*c', 5, true), ('distributive_property_subtraction', 'algebraic', 'a*(b - c)', 'a*b - a*c', 5, true),
 ('sum_of_cubes', 'algebraic', 'a**3 + b**3', '(a + b)*(a**2 - a*b + b**2)', 3, true), ('difference_of_cubes', 'algebraic', 'a**3 - b**3', '(a - b)*(a**2 + a*b + b**2)', 3, true),
 ('quadratic_formula_discriminant', 'algebraic', 'b**2 - 4*a*c', 'b**2 - 4*a*c', 2, false), ('zero_product_property', 'algebraic', 'a*b', '0', 2, false), ('additive_identity', 'algebraic', 'a + 0', 'a', 5, true), ('multiplicative_identity', 'algebraic', 'a*1', 'a', 5, true),
 ('pythagorean_identity', 'trigonometric', 'sin(x)**2 + cos(x)**2', '1', 5, false), ('double_angle_sine', 'trigonometric', 'sin(2*x)', '2*sin(x)*cos(x)', 3, true),
 ('double_angle_cosine_form1', 'trigonometric', 'cos(2*x)', 'cos(x)**2 - sin(x)**2', 3, true), ('double_angle_cosine_form2', 'trigonometric', 'cos(2*x)', '2*cos(x)**2 - 1', 3, true), ('double_angle_cosine_form3', 'trigonometric', 'cos(2*x)', '1 - 2*sin(x)**2', 3, true),
 ('sum_angle_sine', 'trigonometric', 'sin(a + b)', 'sin(a)*cos(b) + cos(a)*sin(b)', 3, true), ('difference_angle_sine', 'trigonometric', 'sin(a - b)', 'sin(a)*cos(b) - cos(a)*sin(b)', 3, true),
 ('sum_angle_cosine', 'trigonometric', 'cos(a + b)', 'cos(a)*cos(b) - sin(a)*sin(b)', 3, true), ('difference_angle_cosine', 'trigonometric', 'cos(a - b)', 'cos(a)*cos(b) + sin(a)*sin(b)', 3, true),
 ('tangent_identity', 'trigonometric', 'tan(x)', 'sin(x)/cos(x)', 4, true), ('cotangent_identity', 'trigonometric', 'cot(x)', 'cos(x)/sin(x)', 4, true), ('secant_identity', 'trigonometric', 'sec(x)', '1/cos(x)', 4, true), ('cosecant_identity', 'trigonometric', 'csc(x)', '1/sin(x)', 4, true),
 ('tangent_squared_identity', 'trigonometric', '1 + tan(x)**2', 'sec(x)**2', 3, true), ('cotangent_squared_identity', 'trigonometric', '1 + cot(x)**2', 'csc(x)**2', 3, true),
 ('logarithm_product', 'logarithmic', 'log(a*b)', 'log(a) + log(b)', 4, true), ('logarithm_quotient', 'logarithmic', 'log(a/b)', 'log(a) - log(b)', 4, true), ('logarithm_power', 'logarithmic', 'log(a**n)', 'n*log(a)', 4, true),
 ('exponential_product', 'exponential', 'a**m * a**n', 'a**(m + n)', 4, true), ('exponential_quotient', 'exponential', 'a**m / a**n', 'a**(m - n)', 4, true), ('exponential_power', 'exponential', '(a**m)**n', 'a**(m*n)', 4, true),
 ('power_rule_derivative', 'calculus', 'Derivative(x**n, x)', 'n*x**(n-1)', 4, false), ('constant_rule_derivative', 'calculus', 'Derivative(c, x)', '0', 5, false), ('sum_rule_derivative', 'calculus', 'Derivative(f + g, x)', 'Derivative(f, x) + Derivative(g, x)', 4, true)
 ) v(id, rule_type, pattern, replacement, priority, bidirectional))"""
CONDITIONED = "('quadratic_formula_discriminant', 'zero_product_property', 'tangent_identity', 'cotangent_identity', 'secant_identity', 'cosecant_identity', 'tangent_squared_identity', 'cotangent_squared_identity', 'logarithm_product', 'logarithm_quotient', 'logarithm_power', 'exponential_quotient')"
BOTH = "rules2 AS (SELECT * FROM rules UNION ALL SELECT id || '_reverse', name || ' (Reverse)', rule_type, replacement, pattern, priority - 1, FALSE FROM rules WHERE bidirectional)"


@query("rule_reverse", cte(RULE_ROWS, BOTH) + "SELECT id, rule_type, pattern, replacement, priority, bidirectional FROM rules2")
def rule_reverse(spark, d):
    return strategy.with_reverse(R.builtin(spark)).select("id", "rule_type", "pattern", "replacement", "priority", "bidirectional")


STATEMENT = "sin(x)**2 + cos(x)**2 + y*(a + b)"


@query("rule_score", cte(RULE_ROWS, BOTH) + f"""SELECT id, priority + CASE WHEN length(replacement) < {len(STATEMENT)} THEN 10 ELSE 0 END + CASE WHEN rule_type = 'algebraic' THEN 5 ELSE 0 END + CASE WHEN rule_type = 'trigonometric' THEN 3 ELSE 0 END
 - CASE WHEN id LIKE '%\\_reverse' ESCAPE '\\' THEN 2 ELSE 0 END + CASE WHEN replace(id, '_reverse', '') IN {CONDITIONED} THEN 1 ELSE 0 END::DOUBLE AS score FROM rules2""")
def rule_score(spark, d):
    r = strategy.with_reverse(R.builtin(spark))
    return r.select("id", strategy.rule_score(F.lit(STATEMENT), F.col("rule_type"), F.col("replacement"), F.col("priority"), F.col("id"), F.size("conditions")).alias("score"))


@query("rule_statistics", "SELECT * FROM (VALUES ('algebraic', 13::BIGINT, 11::BIGINT, 5), ('trigonometric', 15, 14, 5), ('logarithmic', 3, 3, 4), ('exponential', 3, 3, 4), ('calculus', 3, 1, 5)) v(rule_type, n, both_ways, top)")
def rule_statistics(spark, d):
    return R.builtin(spark).groupBy("rule_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("bidirectional").alias("both_ways"), F.max("priority").alias("top"))


@query("rule_validation", "WITH " + RULE_ROWS + """ SELECT id, rule_type, TRUE AS parsed, 0 AS n_new, id <> 'zero_product_property' AS sound FROM rules""")
def rule_validation(spark, d):
    return R.usable(R.builtin(spark)).select("id", "rule_type", "parsed", F.size("new_symbols").alias("n_new"), "sound")


def _formulas(spark, d):
    return corpus.theorems(spark, d).select("id", F.col("statement").alias("formula"))


@query("expr_fingerprint")
def expr_fingerprint(spark, d):
    return X.fingerprints(_formulas(spark, d)).select("id", "formula", "parsed", "canonical", F.array_join("symbols", ",").alias("symbols"), "depth", "complexity", F.array_join("functions", ",").alias("functions"), F.array_join("symmetries", ",").alias("symmetries"), "hash")


@query("expr_operations")
def expr_operations(spark, d):
    return X.fingerprints(_formulas(spark, d)).select("id", F.explode("operations").alias("operation", "n")).groupBy("operation").agg(F.sum("n").alias("n"), F.count_distinct("id").alias("formulas"))


@query("expr_embeddings")
def expr_embeddings(spark, d):
    return X.embeddings(_formulas(spark, d)).select("id", "parsed", F.array_join(F.transform("features", lambda x: F.round(x, 6).cast("string")), ",").alias("features"))


@query("expr_validation")
def expr_validation(spark, d):
    t = X.tests(_formulas(spark, d), points=100)
    return validation.roll_up(t.select(F.col("id").alias("formula_id"), "test_type", "passed", "errored"))


@query("expr_hypotheses")
def expr_hypotheses(spark, d):
    h = X.hypotheses(_formulas(spark, d))
    return h.groupBy("hypothesis_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hypothesis").alias("different"), F.min("hypothesis").alias("first"))


@query("expr_pair_hypotheses")
def expr_pair_hypotheses(spark, d):
    return X.pair_hypotheses(_formulas(spark, d)).withColumn("lineage", F.array_join("lineage", "; "))


@query("hypotheses_capped")
def hypotheses_capped(spark, d):
    return X.all_hypotheses(_formulas(spark, d), most=50)


@query("expr_theorems")
def expr_theorems(spark, d):
    h = X.hypotheses(_formulas(spark, d)).select("hypothesis", "hypothesis_type").distinct()
    return X.theorems_from(h).select("id", "statement", "theorem_type", F.array_join("assumptions", "; ").alias("assumptions"), "natural_language")


@query("rewrite_path")
def rewrite_path(spark, d):
    return X.rewrites(_formulas(spark, d), R.builtin(spark), steps=5).select("id", "step", "rule", "result")


EQUATIONS = ["(x + y)**2 = x**2 + 2*x*y + y**2", "sin(x)**2 + cos(x)**2 = 1", "x + 1 = x", "f(x + y) = f(x) + f(y)", "sin(2*x) = 2*sin(x)*cos(x)", "<k>*x + <size> = <size> + <k>*x", "x**2 = <size>", "exp(x)*exp(y) = exp(x + y)"]


def _equations(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), corpus.pick(EQUATIONS).alias("formula"))


# What decides each of EQUATIONS, in turn, found by hand: method, status, confidence.
VERDICTS = [("direct", "proved", 1.0), ("direct", "proved", 1.0), ("substitution", "disproved", 0.8), ("substitution", "inconclusive", 0.6), ("direct", "proved", 1.0), ("direct", "proved", 1.0), ("substitution", "disproved", 0.8), ("direct", "proved", 1.0)]
VERDICT_SQL = ", ".join(f"[{', '.join(text(v[k]) if k < 2 else str(v[k]) for v in VERDICTS)}][p_partkey % 8 + 1] AS {c}" for k, c in enumerate(("method", "status", "confidence")))


@query("proof_attempts", f"SELECT id, method, status, confidence::DOUBLE AS confidence FROM (SELECT p_partkey AS id, {VERDICT_SQL} FROM part)")
def proof_attempts(spark, d):
    tried = X.proof_attempts(_equations(spark, d), R.builtin(spark))
    return strategy.first_result(tried, X.METHODS)


# Status and confidence of each method on each of EQUATIONS, in turn, found by hand. The sixth has no symbol where <k> is 0.
P, I, D, N = "proved", "inconclusive", "disproved", "failed"
STATUS = [
    [(P, 1.0), (P, 0.9), (P, 0.95), (I, 0.6), (P, 1.0), (P, 0.95), (I, 0.8)], [(P, 1.0), (P, 0.9), (P, 0.95), (I, 0.6), (P, 1.0), (P, 0.95), (I, 0.8)], [(I, 0.3), (I, 0.2), (I, 0.3), (D, 0.8), (I, 0.4), (I, 0.2), (D, 0.9)],
    [(I, 0.3), (I, 0.2), (I, 0.3), (I, 0.6), (I, 0.4), (I, 0.2), (N, 0.0)], [(P, 1.0), (I, 0.2), (I, 0.3), (I, 0.6), (P, 1.0), (P, 0.95), (I, 0.8)], [(P, 1.0), (P, 0.9), (P, 0.95), (I, 0.6), (P, 1.0), (I, 0.2), (I, 0.8)],
    [(I, 0.3), (I, 0.2), (I, 0.3), (D, 0.8), (I, 0.4), (I, 0.2), (D, 0.9)], [(P, 1.0), (I, 0.2), (I, 0.3), (I, 0.6), (P, 1.0), (I, 0.2), (I, 0.8)],
]
STATUS_SQL = "known AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {text(m)}, {text(s)}, {c})" for i, own in enumerate(STATUS) for m, (s, c) in zip(X.METHODS, own, strict=True)) + ") v(shape, method, status, confidence))"


@query("proof_statistics", cte(STATUS_SQL) + """SELECT method, status, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM (SELECT method, CASE WHEN shape = 5 AND p_partkey % 7 = 0 AND method = 'numeric' THEN 'proved' ELSE status END AS status,
 CASE WHEN shape = 5 AND p_partkey % 7 = 0 AND method = 'numeric' THEN 1.0 WHEN shape = 5 AND p_partkey % 7 = 0 AND method = 'substitution' THEN 0.1 ELSE confidence::DOUBLE END AS confidence FROM part JOIN known ON shape = p_partkey % 8) GROUP BY method, status""")
def proof_statistics(spark, d):
    tried = X.proof_attempts(_equations(spark, d), R.builtin(spark))
    return tried.groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


# The statement of each of EQUATIONS, in turn, written by hand.
LEAN_SQL = """CASE p_partkey % 8 WHEN 0 THEN '(x y : ℝ) : ((x + y) ^ 2) = ((2 * x * y) + (x ^ 2) + (y ^ 2))' WHEN 1 THEN '(x : ℝ) : (((Real.cos x) ^ 2) + ((Real.sin x) ^ 2)) = 1' WHEN 2 THEN '(x : ℝ) : (x + 1) = x' WHEN 3 THEN '(x y : ℝ) : (f (x + y)) = ((f x) + (f y))'
 WHEN 4 THEN '(x : ℝ) : (Real.sin (2 * x)) = (2 * (Real.cos x) * (Real.sin x))' WHEN 6 THEN '(x : ℝ) : (x ^ 2) = ' || p_size WHEN 7 THEN '(x y : ℝ) : ((Real.exp x) * (Real.exp y)) = (Real.exp (x + y))'
 ELSE CASE p_partkey % 7 WHEN 0 THEN ': ' || p_size || ' = ' || p_size WHEN 1 THEN '(x : ℝ) : (x + ' || p_size || ') = (x + ' || p_size || ')' ELSE '(x : ℝ) : ((' || (p_partkey % 7) || ' * x) + ' || p_size || ') = ((' || (p_partkey % 7) || ' * x) + ' || p_size || ')' END END"""


@query("lean_statements", f"SELECT p_partkey AS id, 'theorem t_' || p_partkey || ' ' || {LEAN_SQL} AS lean, 'failed' AS verdict FROM part")
def lean_statements(spark, d):
    t = X.lean_statements(_equations(spark, d))
    return t.select("id", "lean", X.simulated_verdict(F.col("lean")).alias("verdict"))


ERRORS = ["error: type mismatch at x", "error: unknown constant foo", "warning: unused", "error: unsolved goals", "error: deep recursion"]


@query("lean_errors", f"""SELECT id, kind, count(*) AS n FROM (SELECT id, CASE WHEN contains(p, 'type mismatch') THEN 'type_mismatch' WHEN contains(p, 'unknown') THEN 'unknown_identifier' WHEN contains(p, 'unsolved goals') THEN 'unsolved_goals' ELSE 'other' END AS kind
 FROM (SELECT p_partkey AS id, unnest(list_slice([{", ".join(map(text, ERRORS))}], 1, p_size % 5 + 1)) AS p FROM part) WHERE contains(p, 'error')) GROUP BY id, kind""")
def lean_errors(spark, d):
    parts = F.slice(F.array(*(F.lit(e) for e in ERRORS)), F.lit(1), F.col("p_size") % 5 + 1)
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(X.error_kinds(F.array_join(parts, "\n\n"))).alias("e"))
    return t.groupBy("id", F.col("e.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
