"""Writers: JSON, CSV, text, and graph write-back (survey K1-K11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat(rows: DataFrame, separator: str = "; ") -> DataFrame:
    """Arrays joined to strings, other nested columns as JSON: fit for CSV."""

    def of(f) -> Column:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind == "array<string>":
            return F.array_join(c, separator).alias(f.name)
        return (F.to_json(c) if kind.startswith(("array", "map", "struct")) else c).alias(f.name)

    return rows.select(*(of(f) for f in rows.schema))


def export(rows: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Writes ``rows`` as parquet, json, csv or txt; any other kind is an error."""
    out = rows.write.mode(mode)
    if kind == "parquet":
        out.parquet(path)
    elif kind == "json":
        out.json(path)
    elif kind == "csv":
        flat(rows).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif kind == "txt":
        flat(rows).select(F.concat_ws("\t", *(F.col(f"`{c}`").cast("string") for c in rows.columns)).alias("value")).write.mode(mode).text(path)
    else:
        raise ValueError(f"unknown format {kind}")


def write_by_source(rows: DataFrame, path: str, source: str = "source") -> None:
    """One JSON folder for each source."""
    rows.write.mode("overwrite").partitionBy(source).json(path)


def write_back(nodes: DataFrame, results: DataFrame, columns: list[str], id_col: str = "node_id") -> DataFrame:
    """``nodes`` with the results' ``columns`` set on matching ids (the first result of an id, by its columns), others as they were."""
    first = results.groupBy(id_col).agg(F.min(F.struct(*columns)).alias("__new"))
    both = nodes.join(first, id_col, "left")
    own = [F.coalesce(F.col(f"__new.{c}"), F.col(c)).alias(c) if c in nodes.columns else F.col(f"__new.{c}").alias(c) for c in columns]
    return both.select(*(c for c in nodes.columns if c not in columns), *own)


def proof_trace(steps: DataFrame, id_col: str = "id", step: str = "step", rule: str = "rule", result: str = "result") -> DataFrame:
    """(id, text, latex) of each proof's steps in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(step).alias("n"), F.col(rule).alias("r"), F.col(result).alias("x"))))
    line = lambda s: F.concat(F.lit("Step "), s["n"].cast("string"), F.lit(" ["), s["r"], F.lit("]: "), s["x"])
    tex = lambda s: F.concat(F.lit(r"\text{"), s["r"], F.lit(r":}\quad "), s["x"], F.lit(r" \\"))
    return steps.groupBy(id_col).agg(ordered.alias("s")).select(id_col, F.array_join(F.transform("s", line), "\n").alias("text"), F.array_join(F.transform("s", tex), "\n").alias("latex"))


def report_text(rows: DataFrame, title: str, column: str, order: str) -> DataFrame:
    """(value): a numbered line for each row, for a text writer; numbers come from range partitions."""
    from ..operators.graph import ranks

    return ranks(rows, order).select(F.concat(F.lit(f"{title} "), F.col("rank").cast("string"), F.lit(": "), F.col(column)).alias("value"))
