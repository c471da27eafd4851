"""Formula texts made from the part table, alike in Spark and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table, text

# A text for each remainder of the key; <size> and <k> stand for numbers of the row, <name> for its name.
DOCUMENTS = [
    r"Item <name>: the value $x^<size> + <k>$ is inline.",
    r"Greek $\alpha_{<k>} + \beta^{<size>} \leq \gamma$ in text.",
    r"Display $$\frac{<k>}{<size>} = y$$ short.",
    r"Display $$\frac{x + <size>}{\sqrt{<k>}} \cdot z$$ long.",
    r"\begin{equation}\int_0^{<size>} x^2 dx = <k>\end{equation}",
    r"\begin{equation*}\sum_{i=1}^{<size>} i \geq \pi\end{equation*}",
    "\\begin{align}a &= b + <size> \\\\ c &= d\\end{align} and a paragraph of text\n\nthat goes on in another one",
    r"\begin{gather}f(x) = \sin(<k> x)\end{gather} then \begin{multline*}g = <size>\end{multline*}",
    r"First $u_<k> = v^2$ then again $u_<k> = v^2$ end.",
    r"Numbers $<size>$ and $12345$ only.",
    r"Letters $x$ and $yy$ and $abc def$.",
    r"Long $<long>$ end.",
    r"costs $$$ <size> dollars and more.",
    "% a comment <size>\nText block one $q = <k>$ here\n\nSecond block of text % gone\nends\n\nshort\n",
    r"Sized $\left( a + b_{<k>} \right) \left[ c \right]$ ok.",
    r"Scripts $a^{bc} + a^{d} + e_{fg} + h_{i} - x^2_3$ done.",
    r"Paren \(\sin(<k> x) + \cos^2 x = 1\) and \[\log(<size>) \neq \infty\] here.",
    r"Fonts $\textbf{bold} + \bf x \label{eq:<k>} \tag{<size>} \unknowncmd y$ mixed.",
    r"Mixed $\alpha + β_{<k>} \times 2x \quad y\, z$ Unicode ≤ here.",
    r"Plain words without any formula <name>",
]
FORMULAS = [
    r"x^{<size>} + \alpha_{<k>} \leq 2", r"\frac{<k>}{<size>} + \frac{a + b}{c}", r"\left( x + y \right)^{<k>} \cdot z", r"\sin(x)^2 + \cos(x)^2 = 1", r"e^{<k>} \times \pi \, r",
    r"\dfrac{1}{x} - \tfrac{\beta}{<size>}", r"a_{i} + b_{jk} \; + {} c", r"\sqrt{x} \ln x \quad \exp y", r"\int_0^\infty f(x) dx \approx <size>", r"\foo + \bar{x} \neq ∞", r"  spaced   out  + <k> ",
    r"\alpha\beta\gamma + \Omega", r"α + \delta ≤ <size>", r"x \\ y \! z", r"\left\langle u \right\rangle \left| v \right|", r"plain_text and <k>",
]
INFIX = [
    "x**<k> + <size>*x", "sin(x)**2 + cos(x)**2", "log(x*y) - <k>", "(x + 1)/(y - <size>)", "exp(x)*2 + a_b", "f(x + y) - f(x) - f(y)", "a*b + c*d + <size>", "tan(theta)/<k>", "sqrt(x**2 + <k>)", "<size>",
    "x + y >= <k>", "alpha*beta**2 + integral", "x",
]
TYPES = ["algebraic_identity", "trigonometric", "logarithmic", "exponential", "functional_equation", "generalization", "transformation"]
VALUES = {"size": ("p_size", "CAST(p_size AS VARCHAR)"), "k": ("p_partkey % 7", "CAST(p_partkey % 7 AS VARCHAR)"), "name": ("p_name", "p_name"), "long": ("repeat('a+', 600)", "repeat('a+', 600)")}


def _column(shape: str) -> Column:
    return F.concat(*(F.expr(VALUES[p][0]).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(re.split("<(\\w+)>", shape)) if p))


def _sql(shape: str) -> str:
    return "concat(" + ", ".join(VALUES[p][1] if i % 2 else text(p) for i, p in enumerate(re.split("<(\\w+)>", shape)) if p) + ")"


def pick(shapes: list[str], key: str = "p_partkey") -> Column:
    c = F.lit(None).cast("string")
    for i, s in reversed([*enumerate(shapes)]):
        c = F.when(F.expr(f"{key} % {len(shapes)} = {i}"), _column(s)).otherwise(c)
    return c


def pick_sql(shapes: list[str], key: str = "p_partkey") -> str:
    return f"CASE {key} % {len(shapes)} " + " ".join(f"WHEN {i} THEN {_sql(s)}" for i, s in enumerate(shapes)) + " END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) with formulas of every shape."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), pick(DOCUMENTS).alias("text"))


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pick(FORMULAS).alias("formula"))


def theorems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theorem-like rows: statement, type, symbols, chain, confidence, validation."""
    t = table(spark, sf_dir, "part")
    return t.select(
        F.col("p_partkey").alias("id"), pick(INFIX).alias("statement"), F.element_at(F.array(*(F.lit(x) for x in TYPES)), (F.col("p_partkey") % len(TYPES) + 1).cast("int")).alias("theorem_type"),
        F.split("p_name", " ").alias("symbols"), F.split("p_type", " ").alias("chain"), F.col("p_brand").alias("source"), ((F.col("p_size") % 21) / 20.0).alias("confidence"),
        (F.col("p_size") % 3 != 0).alias("validated"), (F.col("p_size") * 7 % 101 / 100.0).alias("pass_rate"),
    )


DOCUMENTS_SQL = f"documents_ AS (SELECT p_partkey AS doc_id, {pick_sql(DOCUMENTS)} AS text FROM part)"
FORMULAS_SQL = f"formulas AS (SELECT p_partkey AS id, {pick_sql(FORMULAS)} AS formula FROM part)"
THEOREMS_SQL = f"""theorems AS (SELECT p_partkey AS id, {pick_sql(INFIX)} AS statement, [{", ".join(map(text, TYPES))}][p_partkey % {len(TYPES)} + 1] AS theorem_type,
 string_split(p_name, ' ') AS symbols, string_split(p_type, ' ') AS chain, p_brand AS source, (p_size % 21) / 20.0::DOUBLE AS confidence, p_size % 3 <> 0 AS validated, p_size * 7 % 101 / 100.0::DOUBLE AS pass_rate FROM part)"""
