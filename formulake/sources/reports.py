"""Result documents and proof traces (survey K3-K6, K11, A29, E33).

A document is a header of one row and its items. Both are written beside each
other, items in parallel; where one text is asked for, the number of items is
checked first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most items of a document that is made as one text, and most values of a distribution.
MOST_ITEMS, MOST_VALUES = 100_000, 1_000


def header(items: DataFrame, total: str, distributions: dict[str, str] | None = None, **extra: object) -> DataFrame:
    """One row: the number of items as ``total``, a map of counts for each of ``distributions`` (name: column), and ``extra`` values."""
    out = items.agg(F.count(F.lit(1)).alias(total))
    for name, column in (distributions or {}).items():
        counts = items.groupBy(F.col(column).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("k IS NOT NULL")
        if counts.limit(MOST_VALUES + 1).count() > MOST_VALUES:
            raise ValueError(f"{column} has more than {MOST_VALUES} values")
        own = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
        out = out.crossJoin(F.broadcast(own))  # one row each
    return out.select("*", *(F.lit(v).alias(k) for k, v in extra.items()))


def document(head: DataFrame, items: DataFrame, head_name: str, items_name: str, order: str) -> DataFrame:
    """(value): one text of JSON with the header and the items in order; too many items are an error."""
    n = items.limit(MOST_ITEMS + 1).count()
    if n > MOST_ITEMS:
        raise ValueError(f"a document of one text has at most {MOST_ITEMS} items; write its parts instead")
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*items.columns).alias("x"))))
    all_of = items.agg(F.transform(own, lambda r: r["x"]).alias("items"))
    both = head.select(F.struct(*head.columns).alias("head")).crossJoin(F.broadcast(all_of))  # one row each
    return both.select(F.to_json(F.struct(F.col("head").alias(head_name), F.col("items").alias(items_name))).alias("value"))


#: Items of a part of a document.
PART_ITEMS = 10_000


def document_parts(items: DataFrame, items_name: str, order: str, head: DataFrame | None = None, head_name: str = "metadata", item: Column | None = None, size: int = PART_ITEMS) -> DataFrame:
    """(part, value): documents of JSON with ``size`` items each, in order over all parts, and with the header where there is one.

    Parts come from the items' ranks, so no task holds more than a part, however
    many items there are. ``item`` is what stands for an item, its columns by default.
    """
    from ..operators.graph import ranks

    own = F.struct(*(f"`{c}`" for c in items.columns)) if item is None else item
    placed = ranks(items, order).select(F.floor((F.col("rank") - 1) / size).alias("part"), F.struct("rank", own.alias("x")).alias("r"))
    parts = placed.groupBy("part").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]).alias("items"))
    if head is None:
        return parts.select("part", F.to_json(F.struct(F.col("items").alias(items_name))).alias("value"))
    both = parts.crossJoin(F.broadcast(head.select(F.struct(*head.columns).alias("head"))))  # a header is one row
    return both.select("part", F.to_json(F.struct(F.col("head").alias(head_name), F.col("items").alias(items_name))).alias("value"))


def write_parts(parts: DataFrame, path: str) -> None:
    """One file for each part, in a folder of its number."""
    parts.repartition("part").write.mode("overwrite").partitionBy("part").text(path)


def write_document(head: DataFrame, items: DataFrame, path: str, head_name: str, items_name: str) -> None:
    """The header and the items as JSON folders of ``path``, whatever their number."""
    head.coalesce(1).write.mode("overwrite").json(f"{path}/{head_name}")
    items.write.mode("overwrite").json(f"{path}/{items_name}")


def validation_report(results: DataFrame, id_col: str = "formula_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, ids by status, details) of rolled-up results, for ``write_document`` and JSON writers."""
    from ..operators import validation

    details = results.select(F.col(id_col).cast("string").alias("formula_id"), "status", F.col("confidence").alias("confidence_score"), "pass_rate", F.col("total").alias("total_tests"), F.col("n_passed").alias("passed_tests"), F.col("n_failed").alias("failed_tests"), F.col("n_errors").alias("error_tests"))
    return validation.report(results), details.select("status", "formula_id"), details


def plot_data(rows: DataFrame, id_col: str, reduced: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(summary by cluster, points): sizes and shares of the clusters, and (id, x, y, label) of each row; label -1 is noise."""
    points = rows.select(F.col(id_col).alias("id"), F.col(reduced)[0].alias("x"), F.col(reduced)[1].alias("y"), F.col(label).alias("label"))
    sizes = points.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return sizes.withColumn("noise", F.col("label") == -1), points


# -- proof traces ------------------------------------------------------------------------------------------------

STEP = "struct<n: int, title: string, source: string, target: string, rule: string, justification: string, confidence: double>"


def _step(n, title, source, target, justification, confidence, rule=None) -> Column:
    as_text = lambda x: x if isinstance(x, Column) else F.lit(x)
    parts = {"n": F.lit(n) if isinstance(n, int) else n, "title": as_text(title), "source": as_text(source), "target": as_text(target), "rule": as_text(rule), "justification": as_text(justification), "confidence": as_text(confidence).cast("double")}
    return F.struct(*(c.cast("int" if k == "n" else "double" if k == "confidence" else "string").alias(k) for k, c in parts.items()))


def trace_steps(theorems: DataFrame, expression: str = "statement", transformation: str = "transformation", chain: str = "chain", symbols: str = "symbols", tests: str = "total_tests", rate: str = "pass_rate", id_col: str = "id") -> DataFrame:
    """(id, method, n, title, source, target, rule, justification, confidence): symbolic, rule-based and validation steps of each theorem.

    Columns that ``theorems`` hasn't give no steps. Of the tested symbols the
    first five have steps of their own.
    """
    have = lambda c: F.col(c) if c in theorems.columns else F.lit(None)
    e, t, percent = have(expression).cast("string"), have(transformation).cast("string"), F.format_string("%.2f%%", have(rate).cast("double") * 100)
    symbolic = F.array_compact(F.array(
        F.when(e.isNotNull(), _step(1, "Original Expression", "Given", e, "Starting expression from theorem statement", 1.0)),
        F.when(e.isNotNull() & t.isNotNull() & (t != ""), _step(2, "Apply Transformation", e, t, F.concat(F.lit("Apply transformation: "), t), 0.95, "symbolic_transformation")),
    ))
    own = F.coalesce(have(chain).cast("array<string>"), F.expr("CAST(array() AS array<string>)"))
    rules = F.transform(own, lambda x, i: _step(i + 1, F.concat(F.lit("Apply "), x), "Previous step", "Transformed expression", F.concat(F.lit("Applied transformation rule: "), x), 0.9, x))
    tested = F.slice(F.coalesce(have(symbols).cast("array<string>"), F.expr("CAST(array() AS array<string>)")), 1, 5)
    first = _step(1, "Validation Testing", "Theorem statement", F.concat(F.lit("Validated with "), have(tests).cast("string"), F.lit(" tests")), F.concat(F.lit("Pass rate: "), percent), have(rate))
    each = F.transform(tested, lambda s, i: _step(i + 2, F.concat(F.lit("Test Symbol: "), s), F.concat(F.lit("Symbol "), s), "Validated", F.concat(F.lit("Symbol validation for "), s), have(rate)))
    validation = F.when(have(tests).isNotNull(), F.concat(F.array(first), each))
    out = None
    for method, steps in (("symbolic", symbolic), ("rule_based", rules), ("validation", validation)):
        part = theorems.select(F.col(id_col).alias("id"), F.lit(method).alias("method"), F.explode(steps.cast(f"array<{STEP}>")).alias("s")).select("id", "method", "s.*")
        out = part if out is None else out.unionByName(part)
    return out


def steps_by_method(steps: DataFrame) -> DataFrame:
    """(id, steps, methods, symbolic, rule_based, validation): numbers of steps in all and by method."""
    each = [F.count_if(F.col("method") == m).alias(m) for m in ("symbolic", "rule_based", "validation")]
    return steps.groupBy("id").agg(F.count(F.lit(1)).alias("steps"), F.count_distinct("method").alias("methods"), *each)


def _ordered(steps: DataFrame, method: str | None) -> DataFrame:
    own = steps if method is None else steps.filter(F.col("method") == method)
    return own.groupBy("id", "method").agg(F.array_sort(F.collect_list(F.struct("n", "title", "source", "target", "rule", "justification", "confidence"))).alias("s"))


def trace_texts(steps: DataFrame, method: str | None = None) -> DataFrame:
    """(id, method, text, latex, json) of each theorem's steps by method, in order; a theorem's steps are few."""
    # The layout of the texts.
    line = lambda k, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}: "), v, F.lit("\n"))).otherwise("")
    step = lambda s: F.concat(F.format_string("Step %d: %s\n", s["n"], s["title"]), F.format_string("From: %s\nTo: %s\n", s["source"], s["target"]), line("Rule", s["rule"]), line("Justification", s["justification"]), F.format_string("Confidence: %.2f%%\n", s["confidence"] * 100), F.lit("-" * 30 + "\n\n"))
    tex = lambda s: F.concat(F.format_string("\\textbf{Step %d: %s}\n\n", s["n"], s["title"]), F.format_string("From: %s\n\nTo: %s\n\n", s["source"], s["target"]), F.when(s["justification"].isNotNull(), F.concat(F.lit("Justification: "), s["justification"], F.lit("\n\n"))).otherwise(""))
    names = F.create_map(*(F.lit(x) for p in {"symbolic": "Symbolic Proof", "rule_based": "Rule-Based Transformations", "validation": "Validation Evidence"}.items() for x in p))
    head = F.concat(F.lit("Proof Steps ("), F.initcap("method"), F.lit(")\n" + "=" * 50 + "\n\n"))
    top = F.concat(F.lit("\\documentclass{article}\n\\usepackage{amsmath}\n\\usepackage{amssymb}\n\\begin{document}\n\n\\section{Theorem "), F.col("id").cast("string"), F.lit("}\n\n\\subsection{"), F.coalesce(F.try_element_at(names, F.col("method")), F.col("method")), F.lit("}\n\n"))
    text = F.concat(head, F.array_join(F.transform("s", step), "")).alias("text")
    latex = F.concat(top, F.array_join(F.transform("s", tex), ""), F.lit("\\end{document}")).alias("latex")
    return _ordered(steps, method).select("id", "method", text, latex, F.to_json(F.struct(F.col("id").alias("theorem_id"), "method", F.col("s").alias("steps"))).alias("json"))
