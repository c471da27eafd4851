"""Roll-ups of test results (survey A4-A7, E16, A14, A22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("PASS", "PARTIAL", "FAIL", "ERROR")


def roll_up(tests: DataFrame, id_col: str = "formula_id") -> DataFrame:
    """One row a formula from its tests (passed, errored, test_type): counts, pass rate, confidence, status."""
    bad = F.col("errored")
    counts = tests.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("passed") & ~bad).alias("n_passed"), F.count_if(~F.col("passed") & ~bad).alias("n_failed"), F.count_if(bad).alias("n_errors"),
        F.count_distinct("test_type").alias("types"), F.count_if(F.col("test_type") == "numerical").alias("n_numerical"),
    )
    rate = F.try_divide(F.col("n_passed"), F.col("total"))
    out = counts.withColumn("pass_rate", F.coalesce(rate, F.lit(0.0)))
    bonus = F.when(F.col("types") >= 3, 0.1).otherwise(0.0) + F.when((F.col("n_numerical") >= 50) & (F.col("pass_rate") > 0.9), 0.1).otherwise(0.0)
    score = F.least(F.lit(1.0), F.col("pass_rate") - F.col("n_errors") / F.col("total") * 0.5 + bonus)
    return out.withColumns({"confidence": F.greatest(F.lit(0.0), score), "status": status(F.col("n_errors"), F.col("total"), F.col("pass_rate"))})


def status(errors: Column, total: Column, rate: Column) -> Column:
    return F.when(errors == total, "ERROR").when(rate >= 0.95, "PASS").when(rate >= 0.7, "PARTIAL").otherwise("FAIL")


def report(results: DataFrame) -> DataFrame:
    """One row over all formulas; averages are over positive values only."""
    n = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    positive = lambda c: F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))
    return results.agg(
        F.count(F.lit(1)).alias("formulas"), *(c.alias(f"n_{s.lower()}") for s, c in n.items()), F.coalesce(F.try_divide(n["PASS"] + n["PARTIAL"], F.count(F.lit(1))), F.lit(0.0)).alias("overall_pass_rate"),
        positive("confidence").alias("average_confidence"), positive("pass_rate").alias("average_pass_rate"), F.sum("total").alias("tests"), F.sum("n_passed").alias("passed_tests"),
    )


def first_errors(results: DataFrame, id_col: str = "formula_id", n: int = 10) -> DataFrame:
    """The first ``n`` formulas that errored, by id."""
    return results.filter("n_errors > 0").orderBy(id_col).limit(n).select(id_col, "n_errors", "status")


def distribution(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts for each of ``values``, zero where there are none."""
    names = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return names.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").na.fill(0, ["n"])


def hypothesis_status(result: Column, confidence: Column, failed: Column) -> Column:
    """(status, confidence) of a hypothesis from its validation."""
    return F.when(failed, F.struct(F.lit("error").alias("status"), F.lit(0.0).alias("confidence"))).when(
        result == "PASS", F.struct(F.lit("validated").alias("status"), confidence.alias("confidence"))
    ).when(result == "PARTIAL", F.struct(F.lit("promising").alias("status"), (confidence * 0.8).alias("confidence"))).otherwise(F.struct(F.lit("rejected").alias("status"), F.lit(0.1).alias("confidence")))


def operation_metrics(rows: DataFrame, operation: str, seconds: str) -> DataFrame:
    """Count, mean, extremes of the run times of each operation."""
    return rows.groupBy(operation).agg(F.count(F.lit(1)).alias("n"), F.avg(seconds).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"))


def frequency_table(rows: DataFrame, column: str) -> DataFrame:
    """Each value's count and percentage of all rows."""
    total = rows.count()
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.try_divide(100.0 * F.col("n"), F.lit(float(total))))
