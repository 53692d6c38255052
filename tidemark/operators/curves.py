"""The curves one draws to see a change: density, smoothed density, cumulative shares and their gap.

All take one numeric column and leave out null and NaN.
"""

from __future__ import annotations

from math import isfinite, pi, sqrt

from pyspark.sql import DataFrame, functions as F

from ..functions.values import number, share
from ..sources.tables import literal_table
from .quantiles import cut_points
from .running import with_running_counts

# Bins of the histogram, points of the smoothed curve.
HISTOGRAM_BINS = 30
CURVE_POINTS = 200

# Points of the smoothed curve that one row of the scan is added to; a row is repeated for each such group.
POINTS_PER_GROUP = 20
GROUP_BANDWIDTHS = 20


def density_histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """bin, lower, upper, n, density: bins of equal width over the column's own range, with area 1.

    Two scans: range and count first (three numbers), then the counts, which are one row per bin and task.
    A column with infinite values has no bins of equal width and is an error.
    """
    values = _numbers(df, column)
    low, high, total = values.agg(F.min("value"), F.max("value"), F.count("*")).first()
    if total == 0:
        return literal_table(df.sparkSession, [], "bin int, lower double, upper double, n bigint, density double")
    _require_finite(column, low, high)
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    bin_of = F.least(F.width_bucket("value", F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)) - 1
    counts = values.groupBy(bin_of.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    # at most one row per bin from here on
    every = df.sparkSession.range(0, bins, 1, 1).select(F.col("id").cast("int").alias("bin"))
    return (
        every.join(F.broadcast(counts), "bin", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .select(
            "bin",
            (F.lit(low) + F.col("bin") * width).alias("lower"),
            (F.lit(low) + (F.col("bin") + 1) * width).alias("upper"),
            "n",
            (F.col("n") / F.lit(total * width)).alias("density"),
        )
    )


def density_curve(df: DataFrame, column: str, points: int = CURVE_POINTS) -> DataFrame:
    """point, x, density: Gaussian kernel density at evenly spaced points over the column's range.

    The bandwidth is Scott's: sample standard deviation times n^(-1/5). Two scans: count, range and
    deviation first (four numbers), then the kernels of every value at every point, which are summed per task
    before the shuffle. A column with infinite values has no range and is an error.

    Points stand in groups, and a value starts from a group's nearer end: with d its distance from there and s the step, both in
    bandwidths, its kernel i points on is exp(-d^2 / 2) exp(d s)^i exp(-s^2 / 2)^(i^2). The last factor is no matter of the value, so two
    exponentials and a product per point are summed. A group spans twenty bandwidths at most: no factor leaves the
    range of doubles before the kernel itself does.
    """
    values = _numbers(df, column)
    n, low, high, deviation = values.agg(
        F.count("*"), F.min("value"), F.max("value"), F.stddev_samp("value")
    ).first()
    if n:
        _require_finite(column, low, high)
    if n < 2 or not deviation:
        return literal_table(df.sparkSession, [], "point int, x double, density double")
    bandwidth = deviation * n ** -0.2
    step = (high - low) / (points - 1)
    size = max(1, min(POINTS_PER_GROUP, int(GROUP_BANDWIDTHS * bandwidth / step)))
    groups = -(-points // size)

    first = F.lit(low) + F.col("group") * F.lit(size * step)
    last = first + F.lit((size - 1) * step)
    up = F.col("value") <= (first + last) / 2
    # how far the value lies beyond the end it starts from, in the direction of the group's points
    ahead = F.when(up, F.col("value") - first).otherwise(last - F.col("value")) / F.lit(bandwidth)
    each = values.select("value", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    starts = each.select("group", up.alias("up"), ahead.alias("ahead")).select(
        "group",
        "up",
        F.exp(F.col("ahead") * F.col("ahead") * F.lit(-0.5)).alias("kernel"),
        F.exp(F.col("ahead") * F.lit(step / bandwidth)).alias("factor"),
    )
    products = [F.col("kernel")]
    for _ in range(size - 1):
        products.append(products[-1] * F.col("factor"))
    sums = starts.groupBy("group", "up").agg(F.array(*[F.sum(x) for x in products]).alias("sums"))
    scale = n * bandwidth * sqrt(2 * pi)
    point = F.col("group") * size + F.when(F.col("up"), F.col("at")).otherwise(size - 1 - F.col("at"))
    square = F.pow(F.col("at") * F.lit(step / bandwidth), F.lit(2))
    # two rows per point
    return (
        sums.select("group", "up", F.posexplode("sums").alias("at", "sum"))
        .select(point.alias("point"), (F.col("sum") * F.exp(square * F.lit(-0.5))).alias("kernels"))
        .filter(F.col("point") < points)
        .groupBy("point")
        .agg(F.sum("kernels").alias("kernels"))
        .select("point", (F.lit(low) + F.col("point") * step).alias("x"), (F.col("kernels") / scale).alias("density"))
    )


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """value, n, cdf: for every distinct value the share of numbers that do not exceed it."""
    values = _numbers(df, column)
    counts = values.groupBy("value").agg(F.count("*").alias("n"))
    return with_running_counts(counts, "value", ["n"], cut_points(values, "value")).select(
        "value", "n", share(F.col("n_upto"), F.col("n_total")).alias("cdf")
    )


def cdf_gap_at(reference: DataFrame, current: DataFrame, column: str, at: float) -> DataFrame:
    """One row: cdf_ref, cdf_cur at one value and the absolute gap. One counter pair per task."""
    both = _both_sides(reference, current, column).agg(
        *[
            share(F.sum(F.when(F.col("value") <= F.lit(float(at)), F.col(n)).otherwise(0)), F.sum(n)).alias(cdf)
            for n, cdf in (("n_ref", "cdf_ref"), ("n_cur", "cdf_cur"))
        ]
    )
    return both.select("cdf_ref", "cdf_cur", F.abs(F.col("cdf_ref") - F.col("cdf_cur")).alias("gap"))


def ks_exact(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """One row: the two-sample Kolmogorov-Smirnov statistic, the smallest value it is reached at,
    and the sizes of the samples. Null where a sample has no numbers."""
    both = _both_sides(reference, current, column)
    counts = (
        both.groupBy("value")
        .agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    )
    running = with_running_counts(counts, "value", ["n_ref", "n_cur"], cut_points(both, "value"))
    gap = F.abs(share(F.col("n_ref_upto"), F.col("n_ref_total")) - share(F.col("n_cur_upto"), F.col("n_cur_total")))
    highest = F.max(F.when(gap.isNotNull(), F.struct(gap.alias("gap"), (-F.col("value")).alias("minus_value"))))
    return running.agg(
        highest.alias("highest"), F.max("n_ref_total").alias("n_ref"), F.max("n_cur_total").alias("n_cur")
    ).select(
        F.col("highest.gap").alias("ks"), (-F.col("highest.minus_value")).alias("at_value"), "n_ref", "n_cur"
    )


def _require_finite(column: str, low: float, high: float) -> None:
    if not (isfinite(low) and isfinite(high)):
        raise ValueError(f"{column} holds infinite values: its range can't be divided evenly")


def _numbers(df: DataFrame, column: str) -> DataFrame:
    return df.select(number(column).alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")


def _both_sides(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return (
        _numbers(reference, column)
        .select("value", one.alias("n_ref"), zero.alias("n_cur"))
        .unionByName(_numbers(current, column).select("value", zero.alias("n_ref"), one.alias("n_cur")))
    )
