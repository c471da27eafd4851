"""Proof strategies and the integration of their results (survey E20, E21, E27, E28, A16-A21, W3-W5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands

# Strategies in order, their base scores, their weights in an integration, those with a formal result, bounds of complexity.
BASE = {"symbolic": 0.7, "rule_based": 0.5, "formal": 0.8, "hybrid_sr": 0.75, "hybrid_sf": 0.85, "comprehensive": 0.9}
INTEGRATION = {"symbolic": 0.4, "rule_based": 0.3, "formal": 0.8, "hybrid_sr": 0.6, "hybrid_sf": 0.7, "comprehensive": 0.9}
FORMAL = ("formal", "hybrid_sf", "comprehensive")
VERY_SIMPLE, SIMPLE, MODERATE, COMPLEX = 0.2, 0.4, 0.6, 0.8


def _add(condition: Column, amount: float) -> Column:
    return F.when(condition, amount).otherwise(0.0)


def adjustments(c: Column, algebraic: Column, trigonometric: Column, logarithmic: Column, exponential: Column, kind: Column) -> dict[str, Column]:
    """What is added to each strategy's base score. Fixed values."""
    identity, trig, functional = kind == "algebraic_identity", kind == "trigonometric", kind == "functional_equation"
    return {
        "symbolic": _add(c < SIMPLE, 0.3) + _add(c > COMPLEX, -0.4) + _add(algebraic & ~trigonometric & ~logarithmic & ~exponential, 0.2) + _add(trigonometric, -0.2) + _add(identity, 0.2),
        "rule_based": _add(c.between(SIMPLE, MODERATE), 0.2) + _add(algebraic, 0.3) + _add(trigonometric, 0.25) + _add(identity, 0.15) + _add(trig, 0.25),
        "formal": _add(identity | trig, 0.2) + _add(c > MODERATE, 0.15) + _add(c < VERY_SIMPLE, -0.3) + _add(trig, 0.2),
        "hybrid_sr": _add(algebraic & (c >= SIMPLE), 0.25) + 0.1 + _add(functional, -0.1),
        "hybrid_sf": _add(c > MODERATE, 0.2) + _add(identity | trig | functional, 0.15) + _add(functional, 0.3),
        "comprehensive": _add(c > COMPLEX, 0.1) + _add(c < SIMPLE, -0.2) + _add(functional | (kind == "generalization"), 0.15) + _add(functional, 0.3),
    }


def score_strategies(rows: DataFrame, statement: str = "statement", kind: str = "theorem_type", complexity: str = "complexity", history: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """(id, strategy, ordinal, score) for each row and strategy, clamped to [0, 1]; one generator, no join.

    ``history`` (strategy, success_rate, mean_time), six rows at most, adds what past runs tell.
    """
    s = F.col(statement)
    flags = [bands.holds(s, k) for k in ("algebraic", "trigonometric", "logarithmic", "exponential")]
    added = adjustments(F.col(complexity), *flags, F.col(kind))
    past = dict.fromkeys(BASE, 0.0)
    if history is not None:
        for r in history.filter(F.col("strategy").isin(*BASE)).limit(len(BASE)).collect():
            rate, seconds = r["success_rate"], r["mean_time"]
            past[r["strategy"]] = (0.1 if rate > 0.8 else -0.1 if rate < 0.3 else 0.0) + (0.05 if seconds < 10 else -0.05 if seconds > 60 else 0.0)
    each = [F.struct(F.lit(k).alias("strategy"), F.lit(i).alias("ordinal"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(BASE[k]) + added[k] + past[k])).alias("score")) for i, k in enumerate(BASE)]
    return rows.select(F.col(id_col).alias("id"), F.explode(F.array(*each)).alias("s")).select("id", "s.*")


def best_strategy(scores: DataFrame) -> DataFrame:
    """(id, strategy, score): the highest score, the first strategy on ties."""
    top = F.max(F.struct("score", (-F.col("ordinal")).alias("o"), "strategy")).alias("top")
    return scores.groupBy("id").agg(top).select("id", "top.strategy", "top.score")


def auto_select(kind: Column, complexity: Column) -> Column:
    return F.when((kind == "algebraic_identity") & (complexity < 0.3), "symbolic").when(complexity > 0.7, "hybrid_sr").when(kind == "functional_equation", "comprehensive").otherwise("hybrid_sr")


def integrate(results: DataFrame, id_col: str = "id") -> DataFrame:
    """One row an id from its strategies' results (strategy, success, confidence, seconds).

    Weighted confidence with a bonus for agreement and a penalty for conflict,
    level, final status, best and worst strategy (the first on ties), variance,
    convergence. With columns steps and result also the strategy with the most
    steps, and the first formal result.
    """
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in INTEGRATION.items() for x in p)), F.col("strategy")), F.lit(0.5))
    ok, c = F.col("success"), F.col("confidence")
    # On ties the first strategy in their order.
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(k) for k in BASE)), F.col("strategy")), F.lit(0)), F.lit(len(BASE) + 1)).cast("int")
    g = results.withColumns({"w": weight, "o": place}).groupBy(id_col).agg(
        F.count(F.lit(1)).alias("methods"), F.count_if(ok).alias("successes"), F.count_if(~ok & (c > 0.3)).alias("conflicts"), F.count_if(ok & (c > 0.7)).alias("strong"), F.count_if(ok & (c > 0.4)).alias("moderate"),
        F.max(F.when(ok, c)).alias("top"), F.try_divide(F.sum(c * F.col("w")), F.sum("w")).alias("weighted"), F.avg(c).alias("mean_confidence"), F.var_pop(c).alias("variance"),
        F.max(F.struct("confidence", (-F.col("o")).alias("o"), "strategy"))["strategy"].alias("best"), F.min(F.struct("confidence", "o", "strategy"))["strategy"].alias("worst"), F.sum("seconds").alias("seconds"),
        *(F.max(F.struct("steps", (-F.col("o")).alias("o"), "strategy"))[k].alias(f"longest_{k}") for k in ("strategy", "steps") if "steps" in results.columns),
        *([F.min(F.when(F.col("strategy").isin(*FORMAL), F.struct("o", "result")))["result"].alias("formal_result")] if "result" in results.columns else []),
    )
    bonus = F.when(F.col("successes") >= 2, F.least(F.lit(0.1), (F.col("successes") - 1) * 0.05)).otherwise(0.0)
    penalty = F.when((F.col("successes") > 0) & (F.col("conflicts") > 0), F.least(F.lit(0.1), F.col("conflicts") * 0.03)).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("weighted", F.lit(0.0)) + bonus - penalty))
    final = F.when(F.col("successes") == 0, "failed").when(F.col("strong") > 0, "proved").when((F.col("moderate") >= 2) | ((F.col("moderate") == 1) & (F.col("top") > 0.6)), "proved").otherwise("partially_proved")
    convergent = (F.col("methods") >= 2) & ((F.col("successes") >= F.col("methods") * 0.6) | ((F.col("methods") - F.col("successes")) >= F.col("methods") * 0.6))
    out = g.withColumns({"integrated": score, "final_status": final, "convergent": convergent})
    return out.withColumn("level", bands.integrated_level(F.col("integrated"))).drop("strong", "moderate", "top", "weighted", "conflicts")


def performance(results: DataFrame, by: str = "strategy") -> DataFrame:
    """Attempts, successes, rate, mean confidence and time of each method."""
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("confidence").alias("mean_confidence"), F.avg("seconds").alias("mean_time"))


def history(results: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(strategy, total_attempts, successes, total_time, success_rate, mean_time): the history ``before`` with new results (strategy, success, seconds) added."""
    new = results.groupBy("strategy").agg(F.count(F.lit(1)).alias("total_attempts"), F.count_if("success").alias("successes"), F.sum(F.col("seconds").cast("double")).alias("total_time"))
    if before is not None:
        new = new.unionByName(before.select(*new.columns)).groupBy("strategy").agg(*(F.sum(c).alias(c) for c in new.columns[1:]))
    return new.withColumns({"success_rate": F.col("successes") / F.col("total_attempts"), "mean_time": F.col("total_time") / F.col("total_attempts")})


def first_result(results: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """The first method in ``order`` that proved or disproved; else the result of highest confidence."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("method"))
    decided = F.min(F.when(F.col("status").isin("proved", "disproved"), F.struct(place.alias("o"), "status", "confidence", "method")))
    surest = F.max(F.struct("confidence", (-place).alias("o"), "status", "method"))
    pick = lambda r: F.struct(r["method"].alias("method"), r["status"].alias("status"), r["confidence"].alias("confidence"))
    both = results.groupBy(id_col).agg(decided.alias("d"), surest.alias("s"))
    return both.select(id_col, F.when(F.col("d").isNotNull(), pick(F.col("d"))).otherwise(pick(F.col("s"))).alias("r")).select(id_col, "r.*")


def with_reverse(rules: DataFrame) -> DataFrame:
    """``rules`` and the reverse of the bidirectional ones: pattern and replacement swapped, one priority lower."""
    back = rules.filter("bidirectional").select(
        *(
            {"id": F.concat("id", F.lit("_reverse")), "name": F.concat("name", F.lit(" (Reverse)")), "pattern": F.col("replacement"), "replacement": F.col("pattern"), "priority": F.col("priority") - 1, "bidirectional": F.lit(False)}
            .get(c, F.col(c)).alias(c) for c in rules.columns
        )
    )
    return rules.unionByName(back)


def rule_score(expression: Column, kind: Column, replacement: Column, priority: Column, rule_id: Column, conditions: Column) -> Column:
    """How promising a rule is for an expression."""
    trig = (kind == "trigonometric") & (expression.contains("sin") | expression.contains("cos"))
    return priority.cast("double") + _add(F.length(replacement) < F.length(expression), 10.0) + _add(kind == "algebraic", 5.0) + _add(trig, 3.0) - _add(rule_id.endswith("_reverse"), 2.0) + _add(conditions > 0, 1.0)
