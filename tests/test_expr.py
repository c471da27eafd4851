"""Expressions: known identities, and properties."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from formulake.functions import algebra as A
from formulake.functions import expr as E
from formulake.operators import expressions as X
from formulake.sources import rules as R

RULES = sorted(((i, E.parse(p), E.parse(q), n) for own in R.RULES.values() for i, p, q, _, n, _ in own if E.parse(p)[0] != "sym" and E.equal(E.parse(p), E.parse(q)) is not False), key=lambda r: (-r[3], r[0]))


@pytest.mark.parametrize("bad", ["", "   ", "x +", "1/0", "(x", "x )", "@", "d/dx[x**n]", "x" * 1001, None])
def test_unparsed(bad):
    assert E.parse(bad) is None


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("(x + y)**3", "x**3 + 3x**2*y + 3x*y**2 + y**3", True), ("sin(x)**2", "1 - cos(x)**2", True), ("x + 1", "x", False), ("sin(2x)", "2sin(x)cos(x)", None), ("(a**2 - b**2)/(a - b)", "a + b", True),
        ("sqrt(x)**2", "x", True), ("1/x + 1/y", "(x + y)/(x*y)", True), ("cos(x)**4", "(1 - sin(x)**2)**2", True), ("x*y", "y*x", True), ("x**2", "x**3", False),
    ],
)
def test_equality(a, b, same):
    assert E.equal(E.parse(a), E.parse(b)) is same


def test_calculus():
    assert E.show(E.normal(E.derivative(E.parse("x**3 + 2x"), "x"))) == E.show(E.normal(E.parse("3x**2 + 2")))
    assert E.equal(E.integral(E.parse("3x**2 + a"), "x"), E.parse("x**3 + a*x"))
    assert E.equal(E.taylor(E.parse("exp(x)"), "x"), E.parse("1 + x + x**2/2 + x**3/6 + x**4/24"))
    assert E.taylor(E.parse("1/x"), "x") is None and E.integral(E.parse("sin(x)"), "x") is None


def test_structure():
    t = E.parse("sin(x)**2 + cos(x)**2")
    assert E.symbols(t) == ["x"] and E.functions(t) == ["cos", "sin"] and E.symmetries(t) == ["even", "periodic"]
    assert E.symmetries(E.parse("x**3 - x")) == ["odd"]
    assert E.structure_hash(E.parse("x + y")) == E.structure_hash(E.parse("y + x"))


def test_number_of_tests():
    assert len(X.run_tests("x**2")) == 109 and len(X.run_tests("x**2", points=50)) == 59 and len(X.run_tests("3")) == 2 and X.run_tests("x +") == [("symbolic", False, True)]


@pytest.mark.parametrize(
    ("equation", "verdict"),
    [
        ("(x + y)**2 = x**2 + 2*x*y + y**2", "proved"), ("sin(x)**2 + cos(x)**2 = 1", "proved"), ("x + 1 = x", "disproved"), ("f(x + y) = f(x) + f(y)", "inconclusive"), ("sin(2*x) = 2*sin(x)*cos(x)", "proved"), ("x**2 = 4", "disproved"),
        ("exp(x)*exp(y) = exp(x + y)", "proved"), ("2*x = x", "disproved"), ("log(a*b) = log(a) + log(b)", "proved"), ("1 + tan(x)**2 = sec(x)**2", "proved"), ("sin(x) = cos(x)", "disproved"), ("2 + 2 = 4", "proved"), ("2 + 2 = 5", "disproved"),
        ("log(x, 2) = log(x)/log(2)", "proved"), ("sin(x, y) = 1", "inconclusive"), ("x +", "failed"), ("x", "inconclusive"),
    ],
)
def test_proofs(equation, verdict):
    found = X.prove(equation, RULES)
    assert [m for m, *_ in found] == X.METHODS
    assert verdict in {s for _, s, _, _ in found} and not {"proved", "disproved"} <= {s for _, s, _, _ in found}


def test_methods_differ():
    """Each method decides by its own means."""
    status = lambda text: {m: s for m, s, _, _ in X.prove(text, RULES)}
    trig = status("sin(2*x) = 2*sin(x)*cos(x)")
    assert trig["solver"] == "proved" and trig["algebraic"] == "inconclusive" and trig["pattern"] == "proved" and trig["numeric"] == "inconclusive"
    square = status("(x + 1)**2 = x**2 + 2*x + 1")
    assert square["algebraic"] == square["direct"] == square["simplify"] == square["solver"] == "proved"
    logs = status("log(a*b) = log(a) + log(b)")
    assert logs["pattern"] == "proved" and logs["direct"] == logs["algebraic"] == "inconclusive"
    two = status("x*y = x")  # one symbol at a time leaves the other open; points decide
    assert two["substitution"] in ("disproved", "inconclusive") and two["numeric"] == "disproved"


def test_forms():
    show = lambda f, x: E.show(f(E.parse(x)))
    for text in ("x**2 - 1", "x**3 - 8", "x**2 + 2*x + 1", "6*x**3*y - 6*x*y", "x**2/4 - y**2", "x**2 + 1", "a**3 + b**3", "x**2 - 5*x + 6"):
        t = E.parse(text)
        assert E.equal(A.factored(t), t) and E.equal(A.expanded(A.factored(t)), t)
    assert show(A.factored, "x**2 - 5*x + 6") == "(x - 2)*(x - 3)" and show(A.factored, "x**2 + 1") == "x**2 + 1" and show(A.expanded, "(x + 1)**2") == "2*x + x**2 + 1"
    limits = {("sin(x)/x", "0"): "1", ("(x**2 - 1)/(x - 1)", "1"): "2", ("1/x", "0"): None, ("1/x", "oo"): "0", ("x**3", "-oo"): "-oo", ("(2*x**2 + 1)/(x**2 - x)", "oo"): "2", ("x*exp(1/x)", "0"): None, ("f(x)", "0"): None, ("(1 - cos(x))/x**2", "0"): "1/2"}
    for (text, at), value in limits.items():
        got = A.limit(E.parse(text), "x", at)
        assert (got and E.show(got)) == value, text


def test_hypotheses():
    found = X.unary_hypotheses("sin(x)")
    assert ("generalization", "sin(phi + x)*A", ["amplitude_scaling", "phase_shift"]) in found and ("functional_equation", "f(2*x) = sin(2*x)", ["substitution", "functional_transformation"]) in found
    assert X.unary_hypotheses("log(x, 2)") and ("transformation", "(x - 1)*(x + 1)", ["factorization"]) in X.unary_hypotheses("x**2 - 1")
    assert ("limit", "limit(1/x, x, oo) = 0", ["limit_evaluation"]) in [(k, f.replace("x**(-1)", "1/x"), w) for k, f, w in X.unary_hypotheses("1/x")]


def test_all_hypotheses(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["x**2 - 1", "sin(x)", "x + 1", "log(x, 2)", "x +", None, "sin(x)"])], "id int, formula string")
    got = X.all_hypotheses(rows, most=3).collect()
    kinds = {r["hypothesis_type"] for r in got}
    assert {"functional_equation", "transformation", "limit", "generalization", "composition"} <= kinds
    assert all(sum(r["hypothesis_type"] == k for r in got) <= 3 for k in kinds) and len({(r["hypothesis_type"], r["hypothesis"]) for r in got}) == len(got)


def test_rewriting():
    steps = X.rewrite_sequence(E.parse("sin(t)**2 + cos(t)**2 + y"), RULES)
    assert steps and steps[-1][1] == E.parse("y + 1")
    assert X.path(E.parse("sin(2*u)"), E.parse("2*sin(u)*cos(u)"), RULES) == (["double_angle_sine"], False)
    assert X.path(E.parse("x"), E.parse("y"), RULES) == (None, False) and X.path(E.parse("log(a*b*c)"), E.parse("log(a) + log(b) + log(c)"), RULES, states=1)[1]


def test_rule_pack(spark):
    rules = R.builtin(spark)
    assert rules.count() == rules.select("id").distinct().count() == 37
    found = {r["id"]: r for r in R.usable(rules).collect()}
    assert not found["zero_product_property"]["sound"] and found["double_angle_sine"]["sound"] and found["power_rule_derivative"]["parsed"] and found["sum_of_cubes"]["cases"] == 5
    assert found["tangent_squared_identity"]["new_symbols"] == [] and R.test_cases("a + 0")[:3] == ["0", "1", "-1"]


def test_no_disproved_equation_is_proved(spark):
    from formulake.operators import strategy

    equations = ["x + 1 = x", "x**2 = 4", "2*x = x", "sin(x)**2 = 2", "(x + y)**2 = x**2 + y**2", "sin(x)**2 + cos(x)**2 = 1", "exp(x)*exp(y) = exp(x + y)", "x +", None, "simp = refl"]
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(equations)], "id int, formula string")
    done = {r["id"]: (r["final_status"], r["level"]) for r in strategy.integrate(X.execute_strategies(rows, R.builtin(spark))).collect()}
    verdict = {r["id"]: r["status"] for r in strategy.first_result(X.proof_attempts(rows, R.builtin(spark)), X.METHODS).collect()}
    for i, e in enumerate(equations):
        if verdict.get(i) == "disproved":
            assert done[i][0] == "failed", e
    assert [verdict[i] for i in range(7)] == ["disproved"] * 5 + ["proved"] * 2 and done[5][0] == done[6][0] == "proved"


def test_row_isolation(spark):
    """A formula that breaks an operator breaks no other."""
    odd = ["x**2", "log(x, 2)", "sin(x, y)", "Derivative(x, 2)", "0**(-1)", "x**x**x**x", "f()", "(" * 300 + "x" + ")" * 300, "9**9**9**9", "x" * 2000, None, "1e5", "cot(0)"]
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(odd)], "id int, formula string")
    rules = R.builtin(spark)
    made = [X.fingerprints(rows), X.embeddings(rows), X.hypotheses(rows), X.tests(rows), X.rewrites(rows, rules), X.variations(rows), X.lean_statements(rows), X.proof_attempts(rows, rules), X.applicable_rules(rows, rules)]
    counts = [m.count() for m in made]
    assert all(n > 0 for n in counts[:4]) and counts[1] == len(odd)


def test_external_prover(spark):
    rows = spark.createDataFrame([(1, "theorem t : 1 = 1"), (2, "theorem bad"), (3, None)], "id int, lean string")
    script = "import sys; text = sys.stdin.read(); sys.exit('bad' in text)"
    got = {r["id"]: r["verdict"] for r in X.external_verdicts(rows, ["python3", "-c", script]).collect()}
    assert got == {1: "proved", 2: "failed", 3: "error"}
    assert {r["verdict"] for r in X.external_verdicts(rows, ["/no/such/prover"]).collect()} == {"error"}
    assert {r["verdict"] for r in X.external_verdicts(rows.limit(1), ["python3", "-c", "import time; time.sleep(9)"], timeout=1).collect()} == {"timeout"}


names = st.sampled_from(["x", "y", "2", "3", "z"])
trees = st.recursive(names, lambda c: st.one_of(st.tuples(c, st.sampled_from(["+", "-", "*"]), c).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), c.map(lambda s: f"({s})**2")), max_leaves=6)


@settings(max_examples=60, deadline=None)
@given(trees)
def test_normal_form_is_stable(text):
    t = E.parse(text)
    form = E.normal(t)
    assert E.normal(form) == form and E.equal(t, form) is True
    assert E.equal(E.parse(E.show(t)), t) is True


@settings(max_examples=60, deadline=None)
@given(trees, st.integers(-3, 3), st.integers(-3, 3), st.integers(-3, 3))
def test_values_agree(text, x, y, z):
    values = {"x": float(x), "y": float(y), "z": float(z)}
    a = float(E.evaluate(E.parse(text), values))
    assert a == pytest.approx(float(eval(text, {}, values)))  # noqa: S307
    assert a == pytest.approx(float(E.evaluate(E.normal(E.parse(text)), values)))


def test_sql_functions(spark):
    from formulake.functions.register import register

    register(spark)
    r = spark.sql("SELECT expr_equal('(x+1)**2', 'x**2 + 2x + 1') a, expr_equal('x', 'y') b, expr_equal('sin(2x)', '2sin(x)cos(x)') c, expr_symbols('a*b + a') s, expr_complexity('x +') n, expr_normal('(x+1)*(x-1)') t").first()
    assert (r["a"], r["b"], r["c"], r["s"], r["n"]) == (True, False, None, ["a", "b"], None) and r["t"] == "-1 + x**2" or r["t"] == "x**2 - 1"
    found = spark.sql(r"SELECT kind, start, expression FROM latex_matches('a $x$ b $$y$$')").collect()
    assert {tuple(x) for x in found} == {("inline", 2, "x"), ("block", 8, "y")}
    assert spark.sql("SELECT d.k, m.expression FROM VALUES (1, '$u$'), (2, '') AS d(k, t), LATERAL latex_matches(d.t) m").collect() == [(1, "u")]


@pytest.mark.parametrize(("text", "value"), [("1e-12", 1e-12), ("2.5e3*x", 5000.0), ("1E5", 1e5), ("3.e2", 300.0), (".5e+1 + x", 7.0), ("2e3x", 4000.0), ("7e0", 7.0)])
def test_numbers_with_exponents(text, value):
    assert math.isclose(float(E.evaluate(E.parse(text), {"x": 2.0})), value)


def test_letters_after_numbers_stay_letters():
    assert E.parse("3e") == E.parse("3*e") and E.parse("2*exp(x)") == E.parse("2*e**0*exp(x)/e**0") and E.symbols(E.parse("x1e5")) == ["x1e5"] and E.parse("1e99999") is None


def test_rules_hold_under_their_conditions():
    """No sign is known in a proof, so what holds for positive values only isn't proved, whatever rule leads there."""
    rules = [(i, E.parse(p), E.parse(q), n) for own in R.RULES.values() for i, p, q, _, n, _ in own if i.startswith("logarithm")]
    for text in ("log(x**2) = 2*log(x)", "log(x*y) = log(x) + log(y)", "log(x/y) = log(x) - log(y)"):
        verdict = X.prove(text, rules, positive=False)
        assert not any(s == "proved" for _, s, _, _ in verdict), text
        assert "/" in text or ("numeric", "disproved") in {v[:2] for v in verdict}, text
    assert X.path(E.parse("log(x*y)"), E.parse("log(x) + log(y)"), rules)[0] == ["logarithm_product"]  # under the rule's conditions
    assert X.path(E.parse("log(x*y)"), E.parse("log(x) + log(y)"), rules, positive=False)[0] is None
    for text, proved in (("sqrt(x)**2 = x", True), ("tan(x) = sin(x)/cos(x)", True), ("log(exp(x)) = x", True), ("sqrt(x)*sqrt(y) = sqrt(x*y)", False), ("sqrt(x**2) = x", False)):
        assert any(s == "proved" for _, s, _, _ in X.prove(text, RULES, positive=False)) == proved, text


def test_false_equations_stay_false_through_strategies(spark):
    rows = spark.createDataFrame([(1, "log(x**2) = 2*log(x)"), (2, "(x + 1)**2 = x**2 + 2*x + 1")], "id int, formula string")
    got = {(r["id"], r["strategy"]): r["success"] for r in X.execute_strategies(rows, R.builtin(spark)).collect()}
    assert not any(ok for (i, _), ok in got.items() if i == 1) and got[2, "symbolic"] and not got[2, "formal"]
