"""Rule packs: the built-in rules, and packs read from JSON (survey S14, K10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, name string, rule_type string, pattern string, replacement string, conditions array<string>, justification string, priority int, bidirectional boolean"

# Id, pattern, replacement, conditions, priority, both ways.
RULES = {
    "algebraic": [
        ("square_of_sum", "(a + b)**2", "a**2 + 2*a*b + b**2", [], 4, True),
        ("square_of_difference", "(a - b)**2", "a**2 - 2*a*b + b**2", [], 4, True),
        ("difference_of_squares", "a**2 - b**2", "(a + b)*(a - b)", [], 4, True),
        ("perfect_square_trinomial_positive", "a**2 + 2*a*b + b**2", "(a + b)**2", [], 3, True),
        ("perfect_square_trinomial_negative", "a**2 - 2*a*b + b**2", "(a - b)**2", [], 3, True),
        ("distributive_property", "a*(b + c)", "a*b + a*c", [], 5, True),
        ("distributive_property_subtraction", "a*(b - c)", "a*b - a*c", [], 5, True),
        ("sum_of_cubes", "a**3 + b**3", "(a + b)*(a**2 - a*b + b**2)", [], 3, True),
        ("difference_of_cubes", "a**3 - b**3", "(a - b)*(a**2 + a*b + b**2)", [], 3, True),
        ("quadratic_formula_discriminant", "b**2 - 4*a*c", "b**2 - 4*a*c", ["a != 0"], 2, False),
        ("zero_product_property", "a*b", "0", ["a = 0 or b = 0"], 2, False),
        ("additive_identity", "a + 0", "a", [], 5, True),
        ("multiplicative_identity", "a*1", "a", [], 5, True),
    ],
    "trigonometric": [
        ("pythagorean_identity", "sin(x)**2 + cos(x)**2", "1", [], 5, False),
        ("double_angle_sine", "sin(2*x)", "2*sin(x)*cos(x)", [], 3, True),
        ("double_angle_cosine_form1", "cos(2*x)", "cos(x)**2 - sin(x)**2", [], 3, True),
        ("double_angle_cosine_form2", "cos(2*x)", "2*cos(x)**2 - 1", [], 3, True),
        ("double_angle_cosine_form3", "cos(2*x)", "1 - 2*sin(x)**2", [], 3, True),
        ("sum_angle_sine", "sin(a + b)", "sin(a)*cos(b) + cos(a)*sin(b)", [], 3, True),
        ("difference_angle_sine", "sin(a - b)", "sin(a)*cos(b) - cos(a)*sin(b)", [], 3, True),
        ("sum_angle_cosine", "cos(a + b)", "cos(a)*cos(b) - sin(a)*sin(b)", [], 3, True),
        ("difference_angle_cosine", "cos(a - b)", "cos(a)*cos(b) + sin(a)*sin(b)", [], 3, True),
        ("tangent_identity", "tan(x)", "sin(x)/cos(x)", ["cos(x) != 0"], 4, True),
        ("cotangent_identity", "cot(x)", "cos(x)/sin(x)", ["sin(x) != 0"], 4, True),
        ("secant_identity", "sec(x)", "1/cos(x)", ["cos(x) != 0"], 4, True),
        ("cosecant_identity", "csc(x)", "1/sin(x)", ["sin(x) != 0"], 4, True),
        ("tangent_squared_identity", "1 + tan(x)**2", "sec(x)**2", ["cos(x) != 0"], 3, True),
        ("cotangent_squared_identity", "1 + cot(x)**2", "csc(x)**2", ["sin(x) != 0"], 3, True),
    ],
    "logarithmic": [
        ("logarithm_product", "log(a*b)", "log(a) + log(b)", ["a > 0", "b > 0"], 4, True),
        ("logarithm_quotient", "log(a/b)", "log(a) - log(b)", ["a > 0", "b > 0"], 4, True),
        ("logarithm_power", "log(a**n)", "n*log(a)", ["a > 0"], 4, True),
    ],
    "exponential": [
        ("exponential_product", "a**m * a**n", "a**(m + n)", [], 4, True),
        ("exponential_quotient", "a**m / a**n", "a**(m - n)", ["a != 0"], 4, True),
        ("exponential_power", "(a**m)**n", "a**(m*n)", [], 4, True),
    ],
    "calculus": [
        ("power_rule_derivative", "Derivative(x**n, x)", "n*x**(n-1)", [], 4, False),
        ("constant_rule_derivative", "Derivative(c, x)", "0", [], 5, False),
        ("sum_rule_derivative", "Derivative(f + g, x)", "Derivative(f, x) + Derivative(g, x)", [], 4, True),
    ],
}


def builtin(spark: SparkSession) -> DataFrame:
    """The built-in rules. Some hold under conditions or not at all; what is applied is checked, see ``expressions.load_rules``."""
    rows = [(i, i.replace("_", " ").title(), kind, p, r, conditions, "", n, b) for kind, own in RULES.items() for i, p, r, conditions, n, b in own]
    return spark.createDataFrame(rows, SCHEMA)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON files: arrays of rules, or objects that hold such arrays by category.

    Unreadable files and rules without id or pattern are left out; an id that
    occurs again keeps its first rule by file and place, and so does a repeated
    pair of pattern and replacement.
    """
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    one = F.from_json("value", _array(SCHEMA))
    groups = F.map_values(F.from_json("value", f"map<string,{_array(SCHEMA)}>"))
    rules = text.select("file", F.posexplode(F.when(F.col("value").startswith("["), one).otherwise(F.flatten(groups))).alias("i", "r")).select("file", "i", "r.*")
    good = rules.filter("id IS NOT NULL AND pattern IS NOT NULL AND replacement IS NOT NULL")
    place = F.struct("file", "i")
    for key in (["id"], ["pattern", "replacement"]):
        first = good.groupBy(*key).agg(F.min(place).alias("__p"))
        good = good.join(first, key).filter(place == F.col("__p")).drop("__p")
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    return good.select(*names)


def _array(schema: str) -> str:
    return "array<struct<" + ",".join(":".join(c.strip().split(" ")) for c in schema.split(", ")) + ">>"


#: What is put for a rule's symbols to test it: five cases, each with the next values.
TEST_VALUES = ("0", "1", "-1", "2", "pi", "x", "y")


def test_cases(pattern: str) -> list[str]:
    """The pattern under five assignments of its symbols, in turn from ``TEST_VALUES``; itself where it has none."""
    from ..functions import expr as E

    t = E.parse(pattern)
    own = E.symbols(t) if t else []
    if not own:
        return [pattern]
    values = [E.parse(v) for v in TEST_VALUES]
    return [E.show(E.substitute(t, {s: values[(i + j) % len(values)] for j, s in enumerate(own)})) for i in range(5)]


def usable(rules: DataFrame) -> DataFrame:
    """``rules`` with ``parsed``, ``new_symbols`` (in the replacement only), ``cases`` and ``applied`` (generated cases, and those that the rule changes to something of equal value), and ``sound``.

    ``sound`` is false for rules that bring new symbols or are shown to be no identity.
    """
    import pandas as pd

    def check(frames):
        from ..functions import expr as E
        from ..operators.expressions import same_value

        for f in frames:
            out = []
            for p, r in zip(f["pattern"], f["replacement"], strict=True):
                a, b = E.parse(p), E.parse(r)
                if a is None or b is None:
                    out.append((False, [], 0, 0, False))
                    continue
                new = sorted(set(E.symbols(b)) - set(E.symbols(a)))
                cases = [E.parse(x) for x in test_cases(p)]
                done = [(t, E.rewrite(t, a, b)) for t in cases if t is not None]
                applied = sum(x is not None and same_value(t, x) for t, x in done)
                out.append((True, new, len(cases), applied, not new and E.equal(a, b) is not False))
            made = pd.DataFrame(out, columns=["parsed", "new_symbols", "cases", "applied", "sound"], index=f.index)
            yield pd.concat([f, made], axis=1)

    return rules.mapInPandas(check, f"{SCHEMA}, parsed boolean, new_symbols array<string>, cases int, applied int, sound boolean")


def export(rules: DataFrame) -> DataFrame:
    """One row a type with its rules, for a JSON writer."""
    return rules.groupBy("rule_type").agg(F.array_sort(F.collect_list(F.struct("id", "pattern", "replacement", "priority", "bidirectional"))).alias("rules"))
