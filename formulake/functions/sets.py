"""Sets as arrays: Jaccard and its relatives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def chain_similarity(a: Column, b: Column) -> Column:
    """Jaccard, plus 0.3 of the share of equal places for chains of equal length; at most 1, 0 if one is empty."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    bonus = F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(same, F.size(a)), F.lit(0.0)) * 0.3).otherwise(0.0)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.least(jaccard(a, b) + bonus, F.lit(1.0))).otherwise(0.0)
