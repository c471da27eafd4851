"""Registered queries: name, the query, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sub(c: str, *steps: tuple[str, str]) -> str:
    """SQL for regular-expression replacements, one after the other."""
    for pattern, to in steps:
        c = f"regexp_replace({c}, {text(pattern)}, {text(to)}, 'g')"
    return c


def rep(c: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        c = f"replace({c}, {text(a)}, {text(b)})"
    return c


def n_of(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {text(pattern)}))"


def cte(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
