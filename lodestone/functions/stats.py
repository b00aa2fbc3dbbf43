"""Ratios, confidence bounds and agreement as column expressions.

Three conventions for empty denominators stand side by side on purpose:
``ratio`` gives null, ``ratio_or_zero`` gives 0, ``ratio_or_perfect`` gives 1 where
nothing was expected and nothing was wrong.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the two-sided 95 % quantile of the normal distribution.
Z = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def ratio_or_perfect(hits: Column, wrong: Column, missed: Column, beyond: Column) -> Column:
    """hits / (hits + beyond), rounded to 6 places; 1 if there is nothing at all, 0 if only the denominator is empty."""
    return F.round(F.when(hits + wrong + missed == 0, 1.0).when(hits + beyond == 0, 0.0).otherwise(hits / (hits + beyond)), 6)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def wilson_lower(hits: Column, n: Column, z: float = Z) -> Column:
    """The lower Wilson bound of a share; null without trials."""
    p = hits / n
    z2 = z * z
    centre = p + z2 / (2 * n)
    margin = z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), (centre - margin) / (1 + z2 / n)))


def ppm(share: Column) -> Column:
    """Parts per million, half to even."""
    return F.bround(share * 1_000_000).cast("long")


def kappa(n: Column, agreed: Column, expected_pairs: Column) -> Column:
    """Cohen's kappa from n cases, agreed cases and the sum of products of marginals; null if chance alone agrees always.

    Whole numbers are multiplied out first: (n * agreed - e) / (n * n - e).
    """
    below = n * n - expected_pairs
    return F.when(below != 0, (n * agreed - expected_pairs) / below)
