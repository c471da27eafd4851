"""Formulas as expressions: Arrow functions around ``functions.expr`` (survey E1-E5, E8, E11-E15, E17-E19, E22-E26, E30-E33).

Each operator works on distinct formulas and is joined back, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import algebra as A
from ..functions import expr as E

Frames = Iterator[pd.DataFrame]


#: Rows that a task joins with their results, about.
PART_ROWS = 50_000
#: Most results that are sent to all tasks.
BROADCAST_ROWS = 50_000


def _distinct(rows: DataFrame, formula: str, work: Callable[[str], list[tuple]], schema: str, failed: list[tuple] = ()) -> DataFrame:
    """``work`` on each distinct formula, its rows joined back to all rows of the formula. A formula on which it fails gives the rows ``failed``.

    The results are made once and, where they are few, sent to all tasks. The
    rows are dealt into parts of ``PART_ROWS`` before each gets its results, so
    a file that compresses well is not one task with all of them.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def alone(text: str) -> list[tuple]:
        try:
            return work(text)
        except Exception:  # one formula fails, not the job
            return list(failed)

    def run(frames: Frames) -> Frames:
        for f in frames:
            out = [(x, *row) for x in f["__f"] for row in alone(x)]
            yield pd.DataFrame(out, columns=["__f", *names])

    done = cut(rows.select(F.col(formula).alias("__f")).filter("__f IS NOT NULL").distinct().mapInPandas(run, f"__f string, {schema}"))
    by = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    dealt = rows.repartition(max(1, -(-rows.count() // PART_ROWS)), *by)
    few = F.broadcast(done) if done.count() <= BROADCAST_ROWS else done.hint("merge")
    return dealt.join(few, F.col(f"`{formula}`") == F.col("__f"), "left").drop("__f")


def fingerprints(rows: DataFrame, formula: str = "formula") -> DataFrame:
    """Canonical text, symbols, operation counts, depth, complexity, functions, symmetries, hash; ``parsed`` is false where there is no tree."""

    def work(text: str) -> list[tuple]:
        t = E.parse(text)
        if t is None:
            return [(False, None, [], {}, 0, 0, [], [], None)]
        return [(True, E.show(t), E.symbols(t), E.operations(t), E.depth(t), E.complexity(t), E.functions(t), E.symmetries(t), E.structure_hash(t))]

    schema = "parsed boolean, canonical string, symbols array<string>, operations map<string,int>, depth int, complexity int, functions array<string>, symmetries array<string>, hash string"
    return _distinct(rows, formula, work, schema, [(False, None, [], {}, 0, 0, [], [], None)])


FEATURES = 49
_CLASSES = ("Add", "Mul", "Pow", "Rational", "Integer", "Float", "Symbol")
_NAMES = ("sin", "cos", "tan", "asin", "acos", "atan", "exp", "log", "sqrt", "sinh", "cosh", "tanh")


def features(t: E.Tree) -> list[float]:
    """49 numbers: symbols (6), node classes and their shares (14), functions (15), size (5), predicates (9)."""
    own, ops, text = E.symbols(t), E.operations(t), E.show(t)
    ops = ops | {"Rational": ops.get("Rational", 0) + ops.get("Half", 0)}
    total = sum(ops.values())
    out = [len(own), sum(len(s) == 1 for s in own), "x" in own, "y" in own, any(c.isdigit() for s in own for c in s), sum(s in ("alpha", "beta", "gamma", "theta", "phi", "pi", "omega", "lambda", "mu", "sigma") for s in own)]
    out += [ops.get(c, 0) for c in _CLASSES] + [ops.get(c, 0) / total for c in _CLASSES]
    out += [text.count(n) for n in _NAMES] + [any(n in text for n in ("sin", "cos", "tan")), "exp" in text, "log" in text]
    n, d = _poly(t)
    degree = max((sum(e for _, e in k) for k in n), default=0) if d else -1
    out += [E.complexity(t), len(text), E.depth(t), sum(x[0] in ("num", "sym") for x in E.nodes(t)), degree]
    sym = E.symmetries(t)
    out += [t[0] == "num", t[0] == "sym", t[0] == "add", t[0] == "mul", t[0] == "pow", t[0] == "eq", degree >= 0, "even" in sym, "odd" in sym]
    return [float(x) for x in out]


def _poly(t: E.Tree) -> tuple[dict, bool]:
    if t[0] == "eq":
        return {}, False
    try:
        n, d = E._rational(t)
    except (E.TooLarge, RecursionError):
        return {}, False
    return n, list(d) == [()] and all(s[0] == "sym" for k in n for s, _ in k)


def embeddings(rows: DataFrame, formula: str = "formula") -> DataFrame:
    """``features`` of each formula; zeros, and ``parsed`` false, where there is no tree."""

    def work(text: str) -> list[tuple]:
        t = E.parse(text)
        return [(t is not None, features(t) if t is not None else [0.0] * FEATURES)]

    return _distinct(rows, formula, work, "parsed boolean, features array<double>", [(False, [0.0] * FEATURES)])


# What edge-case tests put in.
EDGES = (0.0, 1.0, -1.0, 1e-10, -1e-10, 1e10, -1e10)


def run_tests(text: str, identity: str | None = None, points: int = 100, span: float = 10.0, seed: int = 42) -> list[tuple[str, bool, bool]]:
    """(test_type, passed, errored) of all tests of a formula: well-formed or identity, finite at random points, edges, round trips."""
    t = E.parse(text)
    if t is None:
        return [("symbolic", False, True)]
    other = E.parse(identity) if identity else None
    plain = E.add(t[1], E.mul(E.MINUS, t[2])) if t[0] == "eq" else t
    out = [("symbolic", True if other is None else E.equal(plain, other) is True, False)]
    own = E.symbols(plain)
    if own:
        rng = np.random.default_rng(seed)
        for kind, values, good in (("numerical", {s: rng.uniform(-span, span, points) for s in own}, np.isfinite), ("edge_case", dict.fromkeys(own, np.array(EDGES)), lambda v: ~np.isnan(v))):
            n = points if kind == "numerical" else len(EDGES)
            try:
                v = np.broadcast_to(np.asarray(E.evaluate(plain, values), np.float64), (n,))
                out += [(kind, bool(x), False) for x in good(v)]
            except (KeyError, OverflowError, TypeError):
                out += [(kind, False, True)] * n
    form = A.simplified(plain)
    out.append(("round_trip", A.same(form, A.simplified(form)) is True, False))
    out += _expansion_trip(plain, own, span, seed)
    return out


def _expansion_trip(t: E.Tree, own: list[str], span: float, seed: int) -> list[tuple[str, bool, bool]]:
    """Where expanding changes the formula: whether it has the values of the factored expansion at three points."""
    try:
        wide = A.expanded(t)
        if wide == t or not own:
            return []
        rng = np.random.default_rng(seed)
        values = {s: rng.uniform(-span, span, 3) for s in own}
        a, b = (np.broadcast_to(np.asarray(E.evaluate(x, values), np.float64), (3,)) for x in (t, A.factored(wide)))
        known = np.isfinite(a) & np.isfinite(b)
        return [("round_trip", bool(np.all(np.abs(a - b)[known] <= 1e-8 * np.maximum(1.0, np.abs(a[known])))), False)]
    except (E.TooLarge, KeyError, TypeError, OverflowError):
        return [("round_trip", False, True)]


def tests(rows: DataFrame, formula: str = "formula", points: int = 100, seed: int = 42) -> DataFrame:
    """The tests of all formulas, a row each; to be rolled up by ``validation.roll_up``."""
    return _distinct(rows, formula, lambda x: run_tests(x, points=points, seed=seed), "test_type string, passed boolean, errored boolean", [("symbolic", False, True)])


def unary_hypotheses(text: str) -> list[tuple[str, str, list[str]]]:
    """(type, formula, lineage) that one formula gives, by its first symbol: functional equations, series, limits, transformations, generalizations."""
    t = E.parse(text)
    if t is None or t[0] == "eq":
        return []
    own, out = E.symbols(t), []
    if own:
        x = own[0]
        s = ("sym", x)
        for label, arg in ((f"f(2*{x})", E.mul(E.num(2), s)), (f"f({x}/2)", E.mul(E.num("1/2"), s)), (f"f(-{x})", E.mul(E.MINUS, s)), (f"f({x} + 1)", E.add(s, E.ONE))):
            out.append(("functional_equation", f"{label} = {E.show(E.substitute(t, {x: arg}))}", ["substitution", "functional_transformation"]))
        series = E.taylor(t, x, 3)
        if series is not None and series != t:
            out.append(("series", E.show(series), ["taylor_expansion"]))
        for at in ("0", "1", "-1", "oo", "-oo"):
            v = A.limit(t, x, at)
            if v is not None:
                out.append(("limit", f"limit({E.show(t)}, {x}, {at}) = {E.show(v)}", ["limit_evaluation"]))
        for name, new in (("derivative", E.derivative(t, x)), ("integral", E.integral(t, x) if len(text) < 50 else None)):
            if new is not None:
                out.append(("transformation", E.show(E.normal(new)), [name]))
    for name, new in (("expansion", A.expanded(t)), ("factorization", A.factored(t))):
        if new != t:
            out.append(("transformation", E.show(new), [name]))
    if _poly(t)[1] and own:
        out.append(("generalization", E.show(E.add(t, ("sym", "a" if "a" not in own else "a_0"))), ["parameter_addition", "polynomial_extension"]))
    if {"sin", "cos"} & set(E.functions(t)) and own:
        wider = _each_function(t, ("sin", "cos"), lambda name, arg: E.mul(("sym", "A"), E.fn(name, E.add(arg, ("sym", "phi")))))
        out.append(("generalization", E.show(wider), ["amplitude_scaling", "phase_shift"]))
    if "exp" in E.functions(t) and own:
        out.append(("generalization", E.show(_each_function(t, ("exp",), lambda name, arg: E.fn(name, E.mul(("sym", "k"), arg)))), ["parameter_scaling", "exponential_extension"]))
    return out


def _each_function(t: E.Tree, names: tuple[str, ...], change) -> E.Tree:
    """``t`` with each function of ``names`` replaced by ``change(name, argument)``, inner ones first."""
    t = A._map(t, lambda c: _each_function(c, names, change))
    return change(t[1], t[2]) if t[0] == "fn" and t[1] in names and len(t) == 3 else t


def hypotheses(rows: DataFrame, formula: str = "formula") -> DataFrame:
    return _distinct(rows, formula, unary_hypotheses, "hypothesis_type string, hypothesis string, lineage array<string>").filter("hypothesis IS NOT NULL")


def pair_hypotheses(rows: DataFrame, formula: str = "formula", first: int = 20, most: int = 50) -> DataFrame:
    """(hypothesis_type, hypothesis, lineage) of pairs of the first distinct formulas, at most ``most`` a type.

    Both limits are part of the operator: it tries the first formulas only.
    """
    own = [r[0] for r in rows.select(formula).distinct().orderBy(formula).limit(first).collect()]

    def run(frames: Frames) -> Frames:
        trees = {x: E.parse(x) for x in own}
        for f in frames:
            out = []
            for i, j in zip(f["i"], f["j"], strict=True):
                a, b = trees[own[i]], trees[own[j]]
                if a is None or b is None or "eq" in (a[0], b[0]):
                    continue
                for kind, new in (("sum", E.normal(E.add(a, b))), ("ratio", E.normal(E.mul(a, E.power(b, E.MINUS))) if b != E.ZERO else None)):
                    if new is not None and not E.symbols(new) and (E.symbols(a) or E.symbols(b)):
                        out.append((i, j, "identity", f"{kind} of ({own[i]}) and ({own[j]}) = {E.show(new)}", [own[i], own[j]]))
                out.append((i, j, "composition", E.show(E.mul(a, b)), [own[i], own[j]]))
                if len(E.symbols(a)) == 1:
                    out.append((i, j, "composition", E.show(E.substitute(a, {E.symbols(a)[0]: b})), [own[i], own[j]]))
            yield pd.DataFrame(out, columns=["i", "j", "hypothesis_type", "hypothesis", "lineage"])

    pairs = [(i, j) for i in range(len(own)) for j in range(i + 1, len(own))]
    made = rows.sparkSession.createDataFrame(pairs, "i int, j int").mapInPandas(run, "i int, j int, hypothesis_type string, hypothesis string, lineage array<string>")


    w = Window.partitionBy("hypothesis_type").orderBy("i", "j", "hypothesis")
    return made.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).select("hypothesis_type", "hypothesis", "lineage")


def all_hypotheses(rows: DataFrame, formula: str = "formula", most: int = 50) -> DataFrame:
    """(hypothesis_type, hypothesis, sources): what all generators give, a bag of different hypotheses with their number of sources, the first ``most`` of each type by text. The cap is part of the operator."""
    from . import search

    one = hypotheses(rows.select(formula).distinct(), formula).select("hypothesis_type", "hypothesis", F.lit(1).alias("sources"))
    both = one.unionByName(pair_hypotheses(rows, formula, most=most).select("hypothesis_type", "hypothesis", F.lit(2).alias("sources")))
    return search.first_of_each(both.groupBy("hypothesis_type", "hypothesis").agg(F.max("sources").alias("sources")), "hypothesis_type", most, "hypothesis")


# -- rules and proofs ---------------------------------------------------------------------------------


#: Most rules of a pack; a larger one is an error, as rules travel to all tasks.
MOST_RULES = 10_000


def load_rules(rules: DataFrame) -> list[tuple[str, E.Tree, E.Tree, int]]:
    """Parsed rules by falling priority, for all tasks. Rules that are shown to be no identity are left out; the others are checked where they are applied."""
    rows = rules.select("id", "pattern", "replacement", "priority").orderBy(F.desc("priority"), "id").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a pack has at most {MOST_RULES} rules")
    found = [(r["id"], E.parse(r["pattern"]), E.parse(r["replacement"]), r["priority"]) for r in rows]
    return [(i, p, q, n) for i, p, q, n in found if p is not None and q is not None and p[0] != "sym" and E.equal(p, q) is not False]


def same_value(a: E.Tree, b: E.Tree, seed: int = 7, positive: bool = True) -> bool:
    """Equal by its forms, or, where that stays open, at random points: positive ones, under which the conditions of rules hold, or points of either sign, where a value on one side only is a difference."""
    known = A.same(a, b)
    if known is not None:
        return known
    own = sorted({*E.symbols(a), *E.symbols(b)})
    rng = np.random.default_rng(seed)
    values = {s: rng.uniform(0.1, 2.0, 8) for s in own}
    if not positive:
        values = {s: np.concatenate([v, rng.uniform(-2.0, 2.0, 24)]) for s, v in values.items()}
    try:
        with np.errstate(all="ignore"):
            return bool(np.allclose(E.evaluate(a, values), E.evaluate(b, values), rtol=1e-8, atol=1e-8, equal_nan=not positive))
    except (KeyError, TypeError):
        return False


def rewrite_sequence(t: E.Tree, rules: list, steps: int = 20, positive: bool = True) -> list[tuple[str, E.Tree]]:
    """Applies the first rule that makes the expression simpler, again and again; ``positive`` as in ``same_value``."""
    out, seen = [], {t}
    for _ in range(steps):
        for name, p, q, _ in rules:
            new = E.rewrite(t, p, q)
            if new is not None and new not in seen and E.complexity(new) <= E.complexity(t) and same_value(t, new, positive=positive):
                out.append((name, new))
                seen.add(new)
                t = new
                break
        else:
            break
    return out


#: Most expressions that a search looks at.
MOST_STATES = 500


def path(start: E.Tree, goal: E.Tree, rules: list, depth: int = 10, branches: int = 5, states: int = MOST_STATES, positive: bool = True) -> tuple[list[str] | None, bool]:
    """Rules that lead from ``start`` to ``goal``, breadth first, and whether the search was cut off at ``states`` expressions.

    A level's expressions are all followed, by the first ``branches`` rules that apply to each.
    """
    if not same_value(start, goal, positive=positive):  # rules keep the value
        return None, False
    level, seen = [(start, [])], {start}
    for _ in range(depth + 1):
        after = []
        for t, own in level:
            if t == goal:
                return own, False
            n = 0
            for name, p, q, _ in rules:
                new = E.rewrite(t, p, q) if n < branches else None
                if new is not None and new not in seen and same_value(t, new, positive=positive):
                    if new == goal:
                        return [*own, name], False
                    if len(seen) >= states:
                        return None, True
                    seen.add(new)
                    after.append((new, [*own, name]))
                    n += 1
        level = after
    return None, False


def paths(rows: DataFrame, rules: DataFrame, start: str = "start", goal: str = "goal", depth: int = 10, branches: int = 5) -> DataFrame:
    """``rows`` with the ``rules`` that lead from one formula to the other, in order (null for none), and ``cut_off``."""
    known = load_rules(rules)

    def work(text: str) -> list[tuple]:
        a, b = (E.parse(x) for x in text.split("\n"))
        return [(None, False)] if a is None or b is None else [path(a, b, known, depth, branches)]

    both = rows.withColumn("__pair", F.concat_ws("\n", F.translate(start, "\n", " "), F.translate(goal, "\n", " ")))
    return _distinct(both, "__pair", work, "rules array<string>, cut_off boolean", [(None, False)]).drop("__pair")


def rewrites(rows: DataFrame, rules: DataFrame, formula: str = "formula", steps: int = 20) -> DataFrame:
    """(step, rule, result) of the rewriting of each formula."""
    known = load_rules(rules)

    def work(text: str) -> list[tuple]:
        t = E.parse(text)
        return [] if t is None or t[0] == "eq" else [(i + 1, name, E.show(x)) for i, (name, x) in enumerate(rewrite_sequence(t, known, steps))]

    return _distinct(rows, formula, work, "step int, rule string, result string").filter("step IS NOT NULL")


# What substitutions put for a symbol; confidences by method: shown, open.
SUBSTITUTES = (0, 1, -1, 2, -2)
SURE = {"direct": (1.0, 0.3), "simplify": (0.9, 0.2), "algebraic": (0.95, 0.3), "solver": (1.0, 0.4)}
NUMERIC_POINTS, NUMERIC_SPAN = 20, 10.0


def _direct(a: E.Tree, b: E.Tree) -> bool:
    """Whether the difference simplifies to 0."""
    return A.simplified(E.add(a, E.mul(E.MINUS, b))) == E.ZERO


def _simplify(a: E.Tree, b: E.Tree) -> bool:
    """Whether both sides get the same simplified, expanded or factored form."""
    return any(f(a) == f(b) for f in (A.simplified, A.expanded, A.factored))


def _algebraic(a: E.Tree, b: E.Tree) -> bool:
    """Whether the expanded sides, or those factored again, are equal; functions stay as they are."""
    a, b = A.expanded(a), A.expanded(b)
    return E.equal(a, b) is True or A.factored(a) == A.factored(b)


def _solver(a: E.Tree, b: E.Tree) -> bool:
    """Whether all on one side vanishes, over few atoms."""
    return A.vanishes(E.add(a, E.mul(E.MINUS, b))) is True


def _counterexample(a: E.Tree, b: E.Tree) -> tuple[str, float]:
    """(status, confidence) from one symbol at a time set to small numbers; only what has no other symbols has a value."""
    own = sorted({*E.symbols(a), *E.symbols(b)})
    if not own:
        return "inconclusive", 0.1
    for v in SUBSTITUTES:
        for s in own:
            left, right = (E.substitute(t, {s: E.num(v)}) for t in (a, b))
            if E.symbols(left) or E.symbols(right):
                continue
            try:
                x, y = (float(E.evaluate(t, {})) for t in (left, right))
            except (KeyError, TypeError, OverflowError, ZeroDivisionError):
                continue
            if np.isfinite(x) and np.isfinite(y) and abs(x - y) > 1e-10 * max(1.0, abs(x)):
                return "disproved", 0.8
    return "inconclusive", 0.6


def _by_rules(a: E.Tree, b: E.Tree, rules: list, positive: bool = True) -> tuple[str, float, str]:
    """(status, confidence, reason): a path of rules, a sequence of them, or an expanded square."""
    steps, cut_off = path(a, b, rules, depth=5, positive=positive)
    if steps:
        return "proved", 0.95, " > ".join(steps)
    if any(A.same(t, b) for _, t in rewrite_sequence(a, rules, 3, positive=positive)):
        return "proved", 0.85, "sequence"
    if any(t[0] == "pow" and t[2] == E.num(2) for t in E.nodes(a)) and A.same(A.expanded(a), b):
        return "proved", 0.9, "square"
    return "inconclusive", 0.2, "search cut off" if cut_off else ""


def _numeric(a: E.Tree, b: E.Tree, seed: int, positive: bool = True) -> tuple[str, float]:
    """(status, confidence) at random points where both sides are real, or, where no sign is assumed, with complex values of roots and logarithms; equal constants are proved."""
    own = sorted({*E.symbols(a), *E.symbols(b)})
    rng, kind = np.random.default_rng(seed), np.float64 if positive else np.complex128
    values = {s: rng.uniform(-NUMERIC_SPAN, NUMERIC_SPAN, NUMERIC_POINTS).astype(kind) for s in own}
    with np.errstate(all="ignore"):
        x, y = (np.broadcast_to(np.asarray(E.evaluate(t, values), kind), (NUMERIC_POINTS,)) for t in (a, b))
        known = np.isfinite(x) & np.isfinite(y)
        # Relative where values are large: a rounding error is no counterexample.
        good = known & (np.abs(x - y) <= 1e-10 * np.maximum(1.0, np.abs(x)))
    if not own and good.all() and abs(x[0] - y[0]) < 1e-12:
        return "proved", 1.0
    if (known & ~good).any():
        return "disproved", 0.9
    return "inconclusive", min(0.8, float(good.mean()))


def prove(text: str, rules: list, seed: int = 42, positive: bool = True) -> list[tuple[str, str, float, str]]:
    """(method, status, confidence, reason) of each method on an equation; status proved, disproved, inconclusive or failed.

    ``positive``: symbols are assumed to meet the conditions that rules have on
    their signs. Without it a rule holds only where it holds for either sign.

    A method that raises has failed, the others still run. A counterexample
    overrules: no method of a disproved equation stays proved.
    """
    t = E.parse(text)
    if t is None:
        return [(m, "failed", 0.0, "no formula") for m in METHODS]
    if t[0] != "eq":
        changed = bool(rewrite_sequence(t, rules, 3))
        return [(m, "inconclusive", SURE[m][1], "no equation") if m in SURE else ("pattern", "inconclusive", 0.6 if changed else 0.2, "no equation") if m == "pattern" else (m, "failed", 0.0, "no equation") for m in METHODS]
    a, b = t[1], t[2]
    shown = {"direct": _direct, "simplify": _simplify, "algebraic": _algebraic, "solver": _solver}
    out = []
    for m in METHODS:
        try:
            if m in shown:
                ok = shown[m](a, b)
                out.append((m, "proved" if ok else "inconclusive", SURE[m][0 if ok else 1], ""))
            elif m == "substitution":
                out.append((m, *_counterexample(a, b), ""))
            elif m == "pattern":
                out.append((m, *_by_rules(a, b, rules, positive)))
            else:
                out.append((m, *_numeric(a, b, seed, positive), ""))
        except Exception as e:  # noqa: BLE001
            out.append((m, "failed", 0.0, type(e).__name__))
    if any(s == "disproved" for _, s, _, _ in out):
        out = [(m, "inconclusive" if s == "proved" else s, SURE.get(m, (0.0, 0.2))[1] if s == "proved" else c, r) for m, s, c, r in out]
    return out


METHODS = ["direct", "simplify", "algebraic", "substitution", "solver", "pattern", "numeric"]


def proof_attempts(rows: DataFrame, rules: DataFrame, formula: str = "formula", positive: bool = False) -> DataFrame:
    """All methods' results for each equation; ``strategy.first_result`` picks the verdict. Unless ``positive``, no sign of a symbol is assumed."""
    known = load_rules(rules)
    return _distinct(rows, formula, lambda x: prove(x, known, positive=positive), "method string, status string, confidence double, reason string", [(m, "failed", 0.0, "error") for m in METHODS])


def lean_statements(rows: DataFrame, formula: str = "formula", id_col: str = "id") -> DataFrame:
    """Each equation as a theorem in the prover's language, with its symbols as real numbers and no proof yet; null where there is no tree."""

    def work(text: str) -> list[tuple]:
        t = E.parse(text)
        return [(None if t is None else f"({' '.join(E.symbols(t))} : ℝ) : {E.to_lean(t)}" if E.symbols(t) else f": {E.to_lean(t)}",)]

    done = _distinct(rows, formula, work, "body string", [(None,)])
    return done.withColumn("lean", F.concat(F.lit("theorem t_"), F.col(id_col).cast("string"), F.lit(" "), F.col("body"))).drop("body")


# Words in a statement by which a simulated prover calls it proved.
INDICATORS = ("trivial", "refl", "simp", "norm_num", "1 + 1 = 2", "True", "x = x")


def simulated_verdict(lean):
    """What the bridge says without a prover: proved by what stands in the statement, failed for others, error without one. It shows nothing."""
    found = F.lit(False)
    for x in INDICATORS:
        found = found | lean.contains(x)
    return F.when(lean.isNull(), "error").when(found, "proved").otherwise("failed")


def external_verdicts(statements: DataFrame, command: list[str], timeout: int = 30, lean: str = "lean") -> DataFrame:
    """``statements`` with ``verdict`` and ``messages`` of an external prover: ``command`` on the executors, with the statement and a proof to try as its input.

    The verdict is proved where it ends with 0 and warns of no gap, failed
    otherwise, timeout after ``timeout`` seconds, error where it can't be run.
    """

    def run(frames: Frames) -> Frames:
        import subprocess

        for f in frames:
            out = []
            for text in f["__f"]:
                try:
                    done = subprocess.run(command, input=f"{text} := by\n  first | rfl | trivial | simp | ring | norm_num\n", capture_output=True, text=True, timeout=timeout, check=False)
                    said = done.stderr + done.stdout
                    out.append((text, "proved" if done.returncode == 0 and "sorry" not in said else "failed", said))
                except subprocess.TimeoutExpired:
                    out.append((text, "timeout", ""))
                except OSError as e:
                    out.append((text, "error", str(e)))
            yield pd.DataFrame(out, columns=["__f", "verdict", "messages"])

    done = statements.select(F.col(lean).alias("__f")).filter("__f IS NOT NULL").distinct().mapInPandas(run, "__f string, verdict string, messages string")
    return statements.join(done, statements[lean] == done["__f"], "left").drop("__f").withColumn("verdict", F.coalesce("verdict", F.lit("error")))


def error_kinds(stderr):
    """Paragraphs of a prover's messages with their kind."""
    parts = F.filter(F.transform(F.split(stderr, "\n\n"), F.trim), lambda p: p.contains("error"))
    kind = lambda p: F.when(p.contains("type mismatch"), "type_mismatch").when(p.contains("unknown"), "unknown_identifier").when(p.contains("unsolved goals"), "unsolved_goals").otherwise("other")
    return F.transform(parts, lambda p: F.struct(kind(p).alias("kind"), p.alias("message")))


def theorems_from(rows: DataFrame, hypothesis: str = "hypothesis", kind: str = "hypothesis_type") -> DataFrame:
    """Hypotheses that parse, as theorems: id, statement, type, symbols, assumptions, description; the rest are dropped."""
    from ..functions import bands as B

    parsed = fingerprints(rows, hypothesis).filter("parsed")
    e, own = F.col("canonical"), F.col("symbols")
    out = parsed.withColumn("theorem_type", B.classify(F.col(hypothesis), e, F.coalesce(F.col(kind), F.lit(""))))
    k = F.col("theorem_type")
    return out.select(
        F.concat(F.lit("THM_"), F.upper(F.left(F.md5(F.concat_ws(":", e, k)), F.lit(8)))).alias("id"), B.formal_statement(e, own).alias("statement"), "theorem_type", own.alias("symbols"), B.assumptions(own, k).alias("assumptions"),
        B.describe(e, k).alias("natural_language"), e.alias("expression"),
    )


def variations(rows: DataFrame, formula: str = "formula", most: int = 5) -> DataFrame:
    """(variation) of each formula by expanding, factoring, simplifying, differentiating, integrating; those that are no formula of ``rows``, the first ``most`` in order."""

    def work(text: str) -> list[tuple]:
        t = E.parse(text)
        if t is None or t[0] == "eq":
            return []
        own = E.symbols(t)
        made = [m for m in (A.expanded(t), A.factored(t), A.simplified(t)) if m != t]
        made += [E.derivative(t, x) for x in own[:1]]
        if len(text) < 50:
            made += [E.integral(t, x) for x in own[:1]]
        return [(i, E.show(m)) for i, m in enumerate(made) if m is not None]

    known = fingerprints(rows, formula).filter("parsed").select(F.col("canonical").alias("variation")).distinct()
    new = _distinct(rows, formula, work, "ordinal int, variation string").filter("variation IS NOT NULL").join(known, "variation", "left_anti")
    names = [*rows.columns, "variation"]
    place = Window.partitionBy(*rows.columns).orderBy("ordinal", "variation")
    first = new.groupBy(*names).agg(F.min("ordinal").alias("ordinal"))
    return first.withColumn("__n", F.row_number().over(place)).filter(F.col("__n") <= most).select(*names)


def applicable_rules(rows: DataFrame, rules: DataFrame, formula: str = "formula") -> DataFrame:
    """(rule, result) of each rule that changes each formula; the pack travels to the tasks, there is no join."""
    known = load_rules(rules)

    def work(text: str) -> list[tuple]:
        t = E.parse(text)
        if t is None or t[0] == "eq":
            return []
        out = [(name, E.rewrite(t, p, q)) for name, p, q, _ in known]
        return [(name, E.show(new)) for name, new in out if new is not None and same_value(t, new)]

    return _distinct(rows, formula, work, "rule string, result string").filter("rule IS NOT NULL")


def execute_strategies(rows: DataFrame, rules: DataFrame, formula: str = "formula", id_col: str = "id") -> DataFrame:
    """(id, strategy, success, confidence, seconds, steps, result) of the six strategies on each equation, for ``strategy.integrate``.

    Symbolic is the verdict of the proof methods; rule-based succeeds where
    rules transform the equation, with a confidence by their number; formal has
    the simulated verdict as its result, which shows nothing, so it succeeds on
    no equation; hybrids are means of their parts. A disproof overrules: no
    strategy succeeds on a disproved equation.
    """
    from . import strategy

    known = load_rules(rules)

    def transformed(text: str) -> list[tuple]:
        t = E.parse(text)
        if t is None:
            return [(0, 0)]
        sides = t[1:] if t[0] == "eq" else (t,)
        n = [sum(len(rewrite_sequence(x, known, most)) for x in sides) for most in (5, 3)]
        return [(min(n[0], 5), min(n[1], 3))]

    equations = rows.select(F.col(id_col).alias("id"), F.col(formula).alias("formula")).distinct()
    symbolic = strategy.first_result(proof_attempts(equations, rules), METHODS)
    steps = _distinct(equations, "formula", transformed, "n5 int, n3 int", [(0, 0)]).drop("formula")
    formal = lean_statements(equations).select("id", simulated_verdict(F.col("lean")).alias("v"))
    both = symbolic.join(steps, "id").join(formal, "id")
    right = F.col("status") != "disproved"
    s, f, n5, n3 = F.col("status") == "proved", F.lit(False), F.col("n5"), F.col("n3")
    sc, fc = F.col("confidence"), F.lit(0.5)
    by_rules = lambda n: F.least(F.lit(0.8), 0.3 + 0.1 * n)
    parts = {
        "symbolic": (s, sc, F.lit(0)), "rule_based": ((n5 > 0) & right, by_rules(n5), n5), "formal": (f, fc, F.lit(0)), "hybrid_sr": (s & (n3 > 0), (sc + by_rules(n3)) / 2, n3), "hybrid_sf": (s | f, (sc + fc) / 2, F.lit(0)),
        "comprehensive": ((s | f | (n5 > 0)) & right, (sc + by_rules(n5) + fc) / 3, n5),
    }
    rows_ = F.array(*(F.struct(F.lit(k).alias("strategy"), ok.alias("success"), c.alias("confidence"), F.lit(0.0).alias("seconds"), n.alias("steps"), (F.col("v") if k in strategy.FORMAL else F.col("status")).alias("result")) for k, (ok, c, n) in parts.items()))
    return both.select("id", F.explode(rows_).alias("x")).select("id", "x.*")
