"""LaTeX text functions against expected values."""

import pytest
from pyspark.sql import functions as F

from formulake.functions import latex as L
from formulake.operators import extract


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "c string").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "cleaned"),
    [
        (r"\alpha + \beta", "α + β"), (r"a \leq b", "a ≤ b"), (r"\frac{a}{b}", "(a) / (b)"), (r"\frac{x + 1}{y}", "frac(x + 1, y)"), (r"\left( x \right)", "( x )"), ("x^{2}", "x^2"), ("x^{ab}", "x^(ab)"), ("x_{i}", "x_i"),
        (r"x\,y", "x y"), (r"\alphax", r"\alphax"), ("  a   b ", "a b"), (r"\alpha\alpha", "αα"),
    ],
)
def test_clean(spark, text, cleaned):
    assert one(spark, text, L.clean) == cleaned


@pytest.mark.parametrize("sign", ["(", "[", r"\{", "|", r"\langle"])
def test_sized_brackets_lose_their_size(spark, sign):
    """Whatever stands inside: cleaning with and without the size gives the same."""
    close = {"(": ")", "[": "]", r"\{": r"\}", "|": "|", r"\langle": r"\rangle"}[sign]
    plain = {r"\{": "{", r"\}": "}", r"\langle": "⟨", r"\rangle": "⟩"}
    for inner in ("q_7", r"\mu + 2w", r"\dfrac{m}{n} - k"):
        sized = one(spark, rf"3\left{sign} {inner} \right{close}", L.clean)
        assert sized == one(spark, f"3{plain.get(sign, sign)} {inner} {plain.get(close, close)}", L.clean) and "left" not in sized


def test_cleaning_twice(spark):
    """A cleaned formula stays as it is."""
    for text in (r"\nu_{3} \simeq \Xi^{k}", r"\tfrac{7}{h} \mp 2", r"g \; \quad w \! z", r"\partial_{t} \rho + \nabla u", r"\prod_{j} (1 - q_{j})"):
        done = one(spark, text, L.clean)
        assert one(spark, done, L.clean) == done, text


@pytest.mark.parametrize(("text", "infix"), [(r"\frac{x + 1}{y}", "frac(x + 1, y)"), (r"\sin x + \pi", "sin x + pi"), (r"\sqrt{x}", "sqrt(x)")])
def test_infix(spark, text, infix):
    assert one(spark, text, L.to_infix) == infix


def test_inline_and_display(spark):
    text = r"a $x + y$ b $$z$$ c \(u\) and \[v\] d \begin{align*}w\end{align*} costs $$$ 5"
    rows = extract.expressions(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {(r["kind"], r["raw"]) for r in rows} >= {("inline", "x + y"), ("inline", "u"), ("block", "z"), ("block", "v"), ("block", "w")}


def test_dedup_keeps_the_surest(spark):
    text = r"$x^2 + 1$ and $$x^2 + 1$$ and $x^2 + 1$"
    rows = extract.extract_formulas(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r["expression"], r["kind"]) for r in rows] == [("x^2 + 1", "block")]


def test_confidence_bounds(spark):
    for text in ("", "x", "12345", "abc def", r"\int_0^\infty e^{-x^2} dx = \frac{\sqrt{\pi}}{2}"):
        assert 0 <= one(spark, text, L.confidence) <= 1
    assert one(spark, "12345", L.confidence) < 0.3 and one(spark, r"\int_0^\infty e^{-x^2} dx", L.confidence) >= 0.8


def test_positions(spark):
    text = r"a \alpha b \beta\gamma"
    rows = extract.with_positions(spark.createDataFrame([(1, text)], "doc_id long, text string"), L.COMMAND).orderBy("start").collect()
    assert [(r["start"], r["raw"]) for r in rows] == [(text.index(r["raw"]), r["raw"]) for r in rows] and len(rows) == 3


def test_every_shape_occurs(spark):
    from formulake.plans import corpus

    d = corpus.documents(spark, "/root/testdata/sf0.001")
    found = {r["s"] for r in extract.extract_formulas(d).select((F.col("doc_id") % 20).alias("s")).distinct().collect()}
    assert found >= {0, 1, 2, 3, 4, 5, 6, 7, 8, 13, 14, 15, 16, 17, 18}


def test_lint_and_identifiers(spark):
    assert one(spark, r"\foo + \alpha", L.unknown_commands) == [r"\foo"]
    assert one(spark, r"\alpha ≤ 1", L.is_mixed) and not one(spark, "x + 1", L.is_mixed)
    assert [one(spark, s, L.identifier) for s in ("", "1a", "a-b")] == ["unnamed_theorem", "theorem_1a", "a_b"]
    assert one(spark, r"\forall x \in \mathbb{R}", L.display_statement) == "∀ x ∈ ℝ"
