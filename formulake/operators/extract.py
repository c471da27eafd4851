"""From texts to formulas: match, score, clean, filter, dedup (survey S3-S5, P1-P6, F1, W1, A1-A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import latex


def expressions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", inline: bool = True, display: bool = True) -> DataFrame:
    """(id, kind, pattern, n, raw) for each match: one scan of the texts, one generator."""
    kinds = [("inline", i, p) for i, p in enumerate(latex.INLINE)] * inline + [("block", i, p) for i, p in enumerate(latex.DISPLAY)] * display
    found = [_tagged(latex.matches(F.col(text_col), p), kind, no) for kind, no, p in kinds]
    return docs.select(F.col(id_col), F.explode(F.concat(*found)).alias("m")).select(id_col, "m.*")


def _tagged(found, kind: str, no: int):
    return F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), F.lit(no).alias("pattern"), i.alias("n"), m.alias("raw")))


def extract_formulas(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dedup: bool = True) -> DataFrame:
    """(id, expression, kind, confidence) of the formulas of each text.

    Equal expressions of a text keep the one with the highest confidence, the
    first on ties (inline before display, patterns in order, then by place).
    """
    found = expressions(docs, id_col, text_col)
    scored = found.select(id_col, "kind", "pattern", "n", latex.preclean(F.col("raw")).alias("expression"), latex.confidence(F.col("raw"), F.col("kind") == "block").alias("confidence"))
    good = scored.filter(latex.is_formula(F.col("expression"), F.col("confidence")))
    if dedup:
        order = Window.partitionBy(id_col, "expression").orderBy(F.desc("confidence"), F.desc("kind"), "pattern", "n")
        good = good.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")
    return good.select(id_col, "expression", "kind", "confidence")


def with_positions(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, raw) of all matches of a pattern, from 0: lengths of the text between matches, summed up."""
    p = "(?s)" + pattern
    gaps, found = F.split(text_col, p, -1), F.regexp_extract_all(text_col, F.lit(p), F.lit(0))
    parts = docs.select(id_col, F.posexplode(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("raw"))).alias("i", "m"))
    before = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("m.gap") + F.length("m.raw")).over(before), F.lit(0)) + F.length("m.gap")
    return parts.select(id_col, start.alias("start"), F.col("m.raw").alias("raw"))


def math_statistics(docs: DataFrame, group: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind and by confidence band, and of environments, for each value of ``group``."""
    keyed = docs.select(F.struct(id_col, group).alias("__k"), text_col)
    e = extract_formulas(keyed, "__k", text_col).select(F.col(f"__k.{group}").alias(group), "kind", "confidence")
    by_kind = e.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "inline").alias("n_inline"), F.count_if(F.col("kind") == "block").alias("n_block"), F.count_if(F.col("confidence") > 0.8).alias("high"),
        F.count_if(F.col("confidence").between(0.5, 0.8)).alias("medium"), F.count_if(F.col("confidence") < 0.5).alias("low"),
    )
    by_env = docs.groupBy(group).agg(*(F.sum(F.size(latex.environment(F.col(text_col), x))).alias(f"n_{x}") for x in latex.ENVIRONMENTS))
    return by_env.join(by_kind, group, "left").na.fill(0)


def symbol_statistics(formulas: DataFrame, formula_col: str = "formula") -> DataFrame:
    """One row of sums over all formulas: commands, Unicode signs, fractions, scripts, functions."""
    c = F.col(formula_col)
    signs = sorted(set(latex.SYMBOLS.values()))
    unicode = sum((F.try_divide(F.length(c) - F.length(F.replace(c, F.lit(s), F.lit(""))), F.lit(len(s))).cast("long") for s in signs), F.lit(0).cast("long"))
    return formulas.agg(
        F.count(F.lit(1)).alias("total"), F.sum(latex.count(c, latex.COMMAND)).alias("commands"), F.sum(unicode).alias("unicode_symbols"), F.sum(latex.count(c, latex.FRACTION)).alias("fractions"),
        F.sum(latex.count(c, latex.SCRIPT["superscripts"])).alias("superscripts"), F.sum(latex.count(c, latex.SCRIPT["subscripts"])).alias("subscripts"), F.sum(latex.count(c, latex.FUNCTION)).alias("functions"),
    )


def ingestion_report(results: DataFrame, by: list[str]) -> DataFrame:
    """Totals of files and their blocks and formulas; ``results`` (n_blocks, n_formulas, error, and the columns ``by``)."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.sum("n_blocks").alias("blocks"), F.sum("n_formulas").alias("formulas"),
    )
