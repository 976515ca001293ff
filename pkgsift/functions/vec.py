"""Vector arithmetic on ``array<double>`` columns.

Folds run left to right in double precision inside whole-stage codegen
(higher-order functions), so results are reproducible across engines that
fold in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def ZERO() -> Column:
    return F.lit(0.0).cast("double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), ZERO(), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, ZERO(), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 when either norm is 0 or the lengths differ."""
    denom = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (denom != 0), dot(a, b) / denom).otherwise(ZERO())
