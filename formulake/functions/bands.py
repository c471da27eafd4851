"""Bands, flags and scores as Column functions (survey P30-P42)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bands(x: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first bound that ``x`` reaches, from the highest; ``rest`` below all."""
    c = F.lit(rest)
    for bound, name in sorted(steps):
        c = F.when(x >= bound, name).otherwise(c)
    return c


def confidence_level(x: Column) -> Column:
    return bands(x, [(0.95, "Very High"), (0.9, "High"), (0.75, "Medium")], "Low")


def integrated_level(x: Column) -> Column:
    """Five half-open bands of 0.2; 1.0 belongs to the highest."""
    return bands(x, [(0.8, "very_high"), (0.6, "high"), (0.4, "medium"), (0.2, "low")], "very_low")


def insights(pass_rate: Column, tests: Column, seconds: Column) -> Column:
    """What a validation tells: quality, coverage, time."""
    found = F.array(
        bands(pass_rate, [(0.95, "excellent"), (0.8, "good"), (0.6, "moderate")], "poor"), F.when(tests < 10, "limited coverage").when(tests > 100, "comprehensive coverage"),
        F.when(seconds > 10, "long validation"),
    )
    return F.array_compact(found)


def complexity_category(symbols: Column, assumptions: Column) -> Column:
    n = F.size(F.array_distinct(symbols)) + assumptions
    return F.when(n <= 2, "Simple").when(n <= 5, "Moderate").otherwise("Complex")


def is_validated(status: Column, pass_rate: Column) -> Column:
    return (status == "PASS") & (pass_rate >= 0.9)


def node_size(confidence: Column, validated: Column, category: Column, low: int = 10, high: int = 50) -> Column:
    boost = F.when(category == "Moderate", 1.2).when(category == "Complex", 1.4).otherwise(1.0)
    return F.least(low + (high - low) * confidence * F.when(validated, 1.0).otherwise(0.7) * boost, F.lit(float(high))).cast("int")


def importance(confidence: Column, validated: Column, statement: Column) -> Column:
    return F.when(validated, 10.0).otherwise(0.0) + confidence * 5 + F.when(F.length(statement) > 100, 2.0).otherwise(0.0)


def search_score(query: str, statement: Column, description: Column, kind: Column, symbols: Column, validated: Column, confidence: Column) -> Column:
    """Relevance of a row for a query: where the query stands, validation, confidence."""
    q = F.lit(query.lower())
    has = lambda c: F.lower(c).contains(q)
    score = F.when(has(statement), 0.4).otherwise(0.0) + F.when(has(description), 0.3).otherwise(0.0) + F.when(has(kind), 0.2).otherwise(0.0) + F.when(F.exists(symbols, has), 0.1).otherwise(0.0)
    score = score * F.when(validated, 1.1).otherwise(1.0) * (0.8 + 0.2 * confidence)
    return F.lit(0.0) if len(query) < 2 else F.least(score, F.lit(1.0))


def _times(c: Column, s: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))) / len(s)


def string_complexity(expression: Column, symbols: Column) -> Column:
    """Operators, symbols and brackets against 15, at most 1; ** counts as three."""
    n = _times(expression, "+") + _times(expression, "*") + _times(expression, "**") + _times(expression, "(") + F.size(symbols)
    return F.least(n / 15, F.lit(1.0))


# Substrings that tell what an expression holds.
CONTENT = {
    "trigonometric": ["sin", "cos", "tan", "sec", "csc", "cot"],
    "logarithmic": ["log", "ln"],
    "exponential": ["exp", "e**"],
    "rational": ["/", "rational", "fraction"],
    "algebraic": ["+", "*", "expand", "factor"],
}


def holds(expression: Column, kind: str) -> Column:
    found = F.lit(False)
    for s in CONTENT[kind]:
        found = found | F.lower(expression).contains(s)
    return found


def complexity_score(variables: Column, operations: Column, functions: Column, depth: Column, trigonometric: Column, logarithmic: Column) -> Column:
    total = variables * 0.1 + operations * 0.15 + functions * 0.2 + depth * 0.1 + F.when(trigonometric, 0.2).otherwise(0.0) + F.when(logarithmic, 0.15).otherwise(0.0)
    return F.least(total / 2, F.lit(1.0))


# Symbols by what they are.
SYMBOL_KINDS = {"Variables": "x y z a b c n m k".split(), "Operators": "+ - * / = < > ≤ ≥".split(), "Functions": "sin cos tan log exp sqrt".split(), "Constants": "pi e phi".split()}


def symbol_category(symbol: Column) -> Column:
    low = F.lower(symbol)
    c = F.lit("Other")
    for kind, own in reversed(SYMBOL_KINDS.items()):
        c = F.when((symbol if kind == "Operators" else low).isin(*own), kind).otherwise(c)
    return c


# Types that a hint may name.
HINTS = "algebraic_identity trigonometric logarithmic exponential calculus functional_equation generalization composition transformation limit_conjecture series_expansion".split()


def classify(statement: Column, expression: Column, hint: Column) -> Column:
    """The hint, if it names a type; else by content, in a fixed order."""
    e, s = F.lower(expression), F.lower(statement)

    def has(c: Column, words: list[str]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | c.contains(w)
        return found

    equation = expression.rlike("(?<![<>=!])=(?!=)")
    return (
        F.when(hint.isin(*HINTS), hint)
        .when(has(e, ["sin", "cos", "tan", "sec", "csc", "cot"]), "trigonometric")
        .when(has(e, ["exp", "e**"]) & has(e, ["log", "ln", "exp"]), "exponential")
        .when(has(e, ["log", "ln"]), "logarithmic")
        .when(has(s, ["diff", "integra", "derivative", "limit"]), "calculus")
        .when(equation & expression.contains("f("), "functional_equation")
        .when(equation, "algebraic_identity")
        .when(has(statement, ["<", ">"]), "inequality")
        .when(has(s, ["lim"]), "limit_conjecture")
        .otherwise("algebraic_identity")
    )


def formal_statement(expression: Column, symbols: Column) -> Column:
    own = F.array_sort(F.array_distinct(symbols))
    return F.when(F.size(own) > 0, F.concat(F.lit("∀"), F.array_join(own, ", "), F.lit(" ∈ ℝ, "), expression)).otherwise(expression)


def assumptions(symbols: Column, kind: Column) -> Column:
    """Domains of variables, and of function symbols in functional equations."""
    own, functions = F.array_sort(F.array_distinct(symbols)), F.array(F.lit("f"), F.lit("g"), F.lit("h"))
    real = F.transform(F.array_except(own, functions), lambda s: F.concat(s, F.lit(" ∈ ℝ")))
    maps = F.transform(F.array_intersect(own, functions), lambda s: F.concat(s, F.lit(": ℝ → ℝ")))
    return F.when(kind == "functional_equation", F.concat(real, maps)).otherwise(real)


# Sentences by type.
SENTENCES = {
    "trigonometric": "This trigonometric identity states that ", "logarithmic": "This logarithmic relationship shows that ", "exponential": "This exponential relationship demonstrates that ",
    "calculus": "This calculus theorem establishes that ", "functional_equation": "There exists a functional relationship defined by ", "generalization": "This theorem generalizes the mathematical relationship expressed by ",
    "composition": "The composition of mathematical operations yields ", "transformation": "Under the given transformation, the expression becomes ",
}


def describe(expression: Column, kind: Column) -> Column:
    c = F.concat(F.lit("This mathematical relationship holds: "), expression)
    c = F.when(kind == "algebraic_identity", F.concat(F.lit("The expression "), expression, F.lit(" represents an algebraic identity"))).otherwise(c)
    for k, s in SENTENCES.items():
        c = F.when(kind == k, F.concat(F.lit(s), expression)).otherwise(c)
    return c
