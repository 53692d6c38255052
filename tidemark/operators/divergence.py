"""Two sets of counts, aligned key by key, and their distances, one row per feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import distances as d
from ..functions.values import share

KEY = ("feature", "feature_type", "kind", "ord", "key")


def pair(reference: DataFrame, current: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Full outer match of two count tables (KEY columns and n) into n_ref and n_cur; absent is 0.

    A union and one aggregate: a single shuffle, and null keys match like any other. carried names
    further counts of current to keep.
    """
    zero = F.lit(0).cast("bigint")
    sides = [
        reference.select(*KEY, F.col("n").alias("n_ref"), zero.alias("n_cur"), *[zero.alias(c) for c in carried]),
        current.select(*KEY, zero.alias("n_ref"), F.col("n").alias("n_cur"), *carried),
    ]
    return (
        sides[0]
        .unionByName(sides[1])
        .groupBy(*KEY)
        .agg(*[F.sum(c).alias(c) for c in ("n_ref", "n_cur", *carried)])
    )


def align(paired: DataFrame, eps: float) -> DataFrame:
    """Add p_ref and p_cur (shares floored at eps, then rescaled to sum 1) and the gap of their running sums.

    Bins run in numeric order, categories by label. The windows hold one feature's keys: n_bins or
    categorical_top_k, plus two. A side without rows has null shares, hence null distances.
    """
    feature = Window.partitionBy("feature")
    upto = (
        feature.orderBy("ord", "key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def floored(n: str) -> Column:
        total = F.sum(n).over(feature)
        return F.when(total > 0, F.greatest(share(F.col(n), total), F.lit(eps)))

    rescaled = paired.select("*", floored("n_ref").alias("f_ref"), floored("n_cur").alias("f_cur")).select(
        *paired.columns,
        (F.col("f_ref") / F.sum("f_ref").over(feature)).alias("p_ref"),
        (F.col("f_cur") / F.sum("f_cur").over(feature)).alias("p_cur"),
    )
    return rescaled.withColumn("cdf_gap", F.sum("p_ref").over(upto) - F.sum("p_cur").over(upto))


def distances(aligned: DataFrame, eps: float, extra: Sequence[Column] = ()) -> DataFrame:
    """All distances of every feature in one aggregate."""
    p, q = F.col("p_ref"), F.col("p_cur")
    return aligned.groupBy("feature", "feature_type").agg(
        d.psi(p, q, eps).alias("psi"),
        d.js(p, q, eps).alias("js"),
        d.hellinger(p, q).alias("hellinger"),
        d.ks_approx(F.col("cdf_gap")).alias("ks_approx"),
        d.chi_square(p, q, eps).alias("chi_square"),
        d.linf(p, q).alias("linf"),
        *extra,
    )


def measure(reference: DataFrame, current: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Distances between two count tables that are already keyed alike."""
    return distances(align(pair(reference, current), eps), eps)
