"""Quality rules: plain text rules, and a log-likelihood ratio of hashed n-grams. DataFrame functions only.

Words and word pairs are hashed into buckets. Their counts over trusted
documents and over the whole corpus give two multinomials; a document's score
is the mean log ratio of its n-grams. Every document is kept or rejected by one
threshold, which comes from trusted documents that the multinomial hasn't seen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import ranks
from .common import cut, let

BUCKETS = 1 << 14
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Most ids of trusted documents that are sent to all tasks; more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: One trusted document in so many is held out for the threshold.
HELD_OUT = 4
#: The threshold is this quantile of the held-out scores, less the margin.
QUANTILE, MARGIN = 0.01, 0.02

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8


def _repeated(hashes: Column) -> Column:
    """How many words lie in windows (hashes by start) that occur twice or more."""

    def of(ordered: Column) -> Column:  # (hash, start), sorted
        size = F.size(ordered)

        def twice(x: Column, k: Column) -> Column:
            before = F.when(k > 0, F.element_at(ordered, F.greatest(k, F.lit(1)))["h"] == x["h"]).otherwise(False)
            after = F.when(k + 1 < size, F.element_at(ordered, F.least(k + 2, size))["h"] == x["h"]).otherwise(False)
            return before | after

        starts = F.array_sort(F.transform(F.filter(ordered, twice), lambda x: x["i"]))
        last = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("p"))
        return F.aggregate(starts, last, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["p"])).alias("n"), p.alias("p")))["n"]

    return let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of)


def _pairs(a: Column, step: int) -> Column:
    """Hashes of each element with the one ``step`` on."""

    def of(x: Column) -> Column:
        n = F.greatest(F.size(x) - step, F.lit(0))
        return F.zip_with(F.slice(x, 1, n), F.slice(x, step + 1, n), lambda p, q: F.xxhash64(p, q))

    return let(a, of)


def with_text_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the hashes ``__one`` and ``__two`` of words and pairs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("__words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "__one": F.transform("__words", lambda w: F.xxhash64(w)),
    }).drop("__words")
    out = out.withColumn("__two", _pairs(F.col("__one"), 1))
    out = out.withColumn("__eight", _pairs(_pairs(F.col("__two"), 2), 4))
    repeated = F.when(F.size(F.array_distinct("__eight")) < F.size("__eight"), _repeated(F.col("__eight"))).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("n_repeat_words", repeated).drop("__eight")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _bucket(h: Column, kind: int) -> Column:
    """Bucket of a hash; words come before pairs."""
    return (F.pmod(h, F.lit(BUCKETS)) + kind * BUCKETS).cast("int")


def _hashes(docs: DataFrame, text_col: str) -> Column:
    one = F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    return let(one, lambda x: F.concat(F.transform(x, lambda h: _bucket(h, 0)), F.transform(_pairs(x, 1), lambda h: _bucket(h, 1))))


def quantile(rows: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile of a column, between two values by their distance; nulls don't count. The values are placed by ranges, so no task holds all."""
    placed = ranks(rows.select(column).filter(F.col(column).isNotNull()), column)
    n = placed.agg(F.max("rank").alias("n")).first()["n"]
    if not n:
        return None
    at = share * (n - 1)
    low, high = math.floor(at) + 1, math.ceil(at) + 1
    found = {r["rank"]: r[column] for r in placed.filter(F.col("rank").isin(low, high)).collect()}
    return found[low] if low == high else (high - 1 - at) * found[low] + (at - low + 1) * found[high]


def _score(ratios: Column) -> Column:
    """Mean log ratio of words and of pairs, weighed alike; 0 for no words."""

    def mean(hashes: str, kind: int) -> Column:
        total = F.aggregate(hashes, F.lit(0.0), lambda acc, h: acc + F.element_at(ratios, _bucket(h, kind) + 1))
        return F.coalesce(F.try_divide(total, F.size(hashes)), F.lit(0.0))

    return (mean("__one", 0) + mean("__two", 1)) / 2


def log_ratios(target: dict[int, int], raw: dict[int, int]) -> list[float]:
    out = []
    for kind in (0, 1):
        at = range(kind * BUCKETS, (kind + 1) * BUCKETS)
        sums = [sum(x.get(b, 0) for b in at) + SMOOTHING * BUCKETS for x in (target, raw)]
        out += [math.log((target.get(b, 0) + SMOOTHING) / sums[0]) - math.log((raw.get(b, 0) + SMOOTHING) / sums[1]) for b in at]
    return out


def _array(values: list[float]) -> Column:
    """A constant array: one literal that the optimizer folds (a lambda here would run for each element)."""
    return F.split(F.lit(",".join(f"{x:.5f}" for x in values)), ",").cast("array<double>")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``with_text_rules``, ``score`` and ``kept`` added.

    ``kept`` is false where ``base_failed`` is true or ``score`` is below the
    threshold. ``labels`` (doc_id, quality, toxic) names trusted documents:
    quality 1 and not toxic; all of them fit the target, but one in HELD_OUT, and
    these give the threshold. Without any the score is 0 and only the base rules decide. Null texts have no words;
    repeated rows are judged alike; columns of these names in ``docs`` are
    replaced, all others pass through. Texts of any length are read whole.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    docs = docs.drop(*made)
    # Columns named like the helpers here travel under names that nobody has.
    aside = {c: f"{c}_{'_' * max(map(len, docs.columns))}" for c in docs.columns if c in ("__words", "__one", "__two", "__eight", "__held", "__trusted", "__id", "__text")}
    docs = docs.withColumnsRenamed(aside)
    trusted = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    trusted = cut(trusted.select(F.col("doc_id").alias("__trusted"), (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("held out")), F.lit(HELD_OUT)) == 0).alias("__held")))
    trusted = F.broadcast(trusted) if trusted.count() <= BROADCAST_ROWS else trusted.hint("merge")
    known = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(trusted, F.col("__id") == F.col("__trusted"), "left")
    each = known.select("__held", F.explode(_hashes(known, "__text")).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("__held")).alias("fit")).collect()  # bounded by the buckets
    raw, target = ({r["bucket"]: r[c] for r in counts if r[c]} for c in ("n", "fit"))
    threshold, ratios = float("-inf"), [0.0] * (2 * BUCKETS)
    if target:
        ratios = log_ratios(target, raw)
        held = with_text_rules(known.filter("__held").select("__text"), "__text").select(F.when(~F.col("base_failed"), _score(_array(ratios))).alias("score"))
        # Cut, so that its passes don't score again, and no filter on the score is pushed below the join to all documents.
        found = quantile(cut(held), "score", QUANTILE)
        threshold = min(0.0, found if found is not None else float("-inf")) - MARGIN
    out = with_text_rules(docs, text_col).withColumn("score", _score(_array(ratios))).drop("__one", "__two")
    verdict = ~F.col("base_failed") & (F.col("score") >= F.lit(threshold))
    # Tied to the task's number, so that a filter on `kept` isn't pushed below, where all columns would be computed again for it.
    return out.withColumn("kept", F.when(F.spark_partition_id() >= 0, verdict)).withColumnsRenamed({v: k for k, v in aside.items()})
