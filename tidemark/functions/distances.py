"""Distances between two aligned distributions, as aggregate expressions.

Each takes the columns of an aligned table (one row per key, both sides floored and
rescaled to sum 1) and is used inside groupBy(feature).agg(...).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def psi(p: Column, q: Column, eps: float) -> Column:
    """Population stability index."""
    p, q = _floored(p, eps), _floored(q, eps)
    return F.sum((q - p) * F.log(q / p))


def js(p: Column, q: Column, eps: float) -> Column:
    """Jensen-Shannon divergence in nats: between 0 and ln 2."""
    p, q = _floored(p, eps), _floored(q, eps)
    middle = (p + q) / 2
    return F.sum(p * F.log(p / middle) + q * F.log(q / middle)) / 2


def hellinger(p: Column, q: Column) -> Column:
    return F.sqrt(F.sum(F.pow(F.sqrt(p) - F.sqrt(q), F.lit(2.0))) / 2)


def chi_square(p: Column, q: Column, eps: float) -> Column:
    """Chi-square statistic on proportions: not scaled by counts, so it has no p-value."""
    expected = _floored(p, eps)
    return F.sum((q - expected) * (q - expected) / expected)


def ks_approx(cdf_gap: Column) -> Column:
    """Largest gap of the two running sums over ordered keys (see operators.divergence.align)."""
    return F.max(F.abs(cdf_gap))


def linf(p: Column, q: Column) -> Column:
    """Largest difference of a single key."""
    return F.max(F.abs(q - p))


def _floored(p: Column, eps: float) -> Column:
    # greatest() would turn a null share (an empty side) into eps
    return F.when(p.isNotNull(), F.greatest(p, F.lit(eps)))
