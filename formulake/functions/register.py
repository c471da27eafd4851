"""SQL names for the engine's functions: Arrow functions on expressions, a table function of formulas in a text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from . import expr as E
from . import latex


def _texts(values: pd.Series, f) -> pd.Series:
    """``f`` of each distinct formula's tree; null where there is none."""
    known = {x: (None if (t := E.parse(x)) is None else f(t)) for x in set(values.dropna())}
    return values.map(lambda x: known.get(x) if isinstance(x, str) else None).astype(object)


def expr_canonical(formula: pd.Series) -> pd.Series:
    return _texts(formula, E.show)


def expr_normal(formula: pd.Series) -> pd.Series:
    return _texts(formula, lambda t: E.show(E.normal(t)))


def expr_symbols(formula: pd.Series) -> pd.Series:
    return _texts(formula, E.symbols)


def expr_complexity(formula: pd.Series) -> pd.Series:
    return _texts(formula, E.complexity).astype("Int32")


def expr_hash(formula: pd.Series) -> pd.Series:
    return _texts(formula, E.structure_hash)


def expr_lean(formula: pd.Series) -> pd.Series:
    return _texts(formula, E.to_lean)


def expr_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    """True or false where the normal forms show it, else null."""

    def one(x, y):
        s, t = E.parse(x), E.parse(y)
        return None if s is None or t is None else E.equal(s, t)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


_PATTERNS = [("inline", re.compile(p, re.DOTALL)) for p in latex.INLINE] + [("block", re.compile(p, re.DOTALL)) for p in latex.DISPLAY]


class LatexMatches:
    """All formulas of a text with their places, from 0."""

    def eval(self, text: str):
        for kind, pattern in _PATTERNS:
            for m in pattern.finditer(text or ""):
                yield kind, m.start(), m.group(0), m.group(1)


def register(spark: SparkSession) -> list[str]:
    """Makes all of them callable from SQL; returns their names."""
    # Wrapped here: workers import this module, too, and have no session to read types with.
    kinds = {expr_canonical: "string", expr_normal: "string", expr_symbols: "array<string>", expr_complexity: "int", expr_hash: "string", expr_lean: "string", expr_equal: "boolean"}
    for f, kind in kinds.items():
        spark.udf.register(f.__name__, pandas_udf(f, kind))
    spark.udtf.register("latex_matches", udtf(LatexMatches, returnType="kind string, start int, raw string, expression string"))
    return [*(f.__name__ for f in kinds), "latex_matches"]
