import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import counting, curves, quantiles


@pytest.fixture(scope="module")
def samples(spark):
    generator = np.random.default_rng(42)
    reference = generator.normal(5000, 1000, 1000)
    current = np.concatenate([generator.normal(4200, 1400, 700), np.full(350, 3000.0)])
    as_table = lambda v: spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "x double")
    return reference, current, as_table(reference).repartition(5), as_table(current).repartition(3)


def test_density_histogram(spark, samples):
    for values, df in ((samples[0], samples[2]), (samples[1], samples[3])):
        density, edges = np.histogram(values, bins=30, density=True)
        found = sorted(curves.density_histogram(df, "x").collect(), key=lambda r: r["bin"])
        assert [r["density"] for r in found] == pytest.approx(density.tolist())
        assert [r["lower"] for r in found] == pytest.approx(edges[:-1].tolist())
        assert sum(r["density"] * (r["upper"] - r["lower"]) for r in found) == pytest.approx(1)


def test_density_histogram_of_constant_and_empty(spark):
    constant = sorted(curves.density_histogram(spark.range(4).selectExpr("2 AS x"), "x", 4).collect())
    assert [(r["lower"], r["n"]) for r in constant] == [(1.5, 0), (1.75, 0), (2.0, 4), (2.25, 0)]
    assert curves.density_histogram(spark.range(0).selectExpr("id AS x"), "x").collect() == []


def test_density_curve(samples):
    for values, df in ((samples[0], samples[2]), (samples[1], samples[3])):
        h = np.std(values, ddof=1) * len(values) ** -0.2
        grid = np.linspace(values.min(), values.max(), 200)
        kernels = np.exp(-0.5 * ((grid[:, None] - values[None, :]) / h) ** 2)
        wanted = kernels.sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
        found = sorted(curves.density_curve(df, "x").collect(), key=lambda r: r["point"])
        assert [r["x"] for r in found] == pytest.approx(grid.tolist())
        assert [r["density"] for r in found] == pytest.approx(wanted.tolist(), rel=1e-9)


def test_density_far_from_all_values(spark):
    """Kernels are added however far away they are."""
    df = spark.range(1000).select(F.when(F.col("id") < 999, F.col("id") / 1000).otherwise(1000.0).alias("x"))
    values = np.append(np.arange(999) / 1000, 1000.0)
    h = np.std(values, ddof=1) * 1000**-0.2
    found = curves.density_curve(df, "x").collect()
    assert len(found) == 200
    for row in found:
        wanted = np.exp(-0.5 * ((row["x"] - values) / h) ** 2).sum() / (1000 * h * np.sqrt(2 * np.pi))
        assert row["density"] == pytest.approx(wanted, rel=1e-6, abs=0)


def test_infinite_values_have_no_even_range(spark):
    df = spark.sql("SELECT explode(array(1D, 2D, DOUBLE('inf'))) AS x")
    for curve in (curves.density_histogram, curves.density_curve):
        with pytest.raises(ValueError, match="infinite"):
            curve(df, "x")
    assert curves.ecdf(df, "x").count() == 3


def test_ecdf(samples):
    values = samples[1]
    found = sorted(curves.ecdf(samples[3], "x").collect(), key=lambda r: r["value"])
    distinct, counts = np.unique(values, return_counts=True)
    assert [r["value"] for r in found] == distinct.tolist()
    assert [r["n"] for r in found] == counts.tolist()
    assert [r["cdf"] for r in found] == pytest.approx((np.cumsum(counts) / len(values)).tolist())


def test_gap_at_a_value(samples):
    reference, current, *tables = samples
    (row,) = curves.cdf_gap_at(*tables, "x", 4500).collect()
    a, b = np.mean(reference <= 4500), np.mean(current <= 4500)
    assert (row["cdf_ref"], row["cdf_cur"], row["gap"]) == pytest.approx((a, b, abs(a - b)))


def test_largest_gap(samples):
    reference, current, *tables = samples
    grid = np.unique(np.concatenate([reference, current]))
    gaps = np.abs(
        np.searchsorted(np.sort(reference), grid, "right") / len(reference)
        - np.searchsorted(np.sort(current), grid, "right") / len(current)
    )
    (row,) = curves.ks_exact(*tables, "x").collect()
    assert row["ks"] == pytest.approx(gaps.max())
    assert row["at_value"] == grid[gaps.argmax()]
    assert (row["n_ref"], row["n_cur"]) == (len(reference), len(current))


def test_largest_gap_needs_two_samples(spark, samples):
    (row,) = curves.ks_exact(samples[2], samples[2].filter("x IS NULL"), "x").collect()
    assert row["ks"] is None


def test_density_of_points_far_apart(spark):
    """Steps of many bandwidths, and values anywhere between the points."""
    values = np.concatenate([np.random.default_rng(1).normal(size=5000), [-4000.0, 4000.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    h = np.std(values, ddof=1) * len(values) ** -0.2
    for row in curves.density_curve(df, "x", 9).collect():
        wanted = np.exp(-0.5 * ((row["x"] - values) / h) ** 2).sum() / (len(values) * h * np.sqrt(2 * np.pi))
        assert row["density"] == pytest.approx(wanted, rel=1e-9, abs=0)


@pytest.mark.parametrize("slice_rows, most", [(100, 130), (3000, 3900)])
def test_slices_grow_with_the_rows(spark, monkeypatch, slice_rows, most):
    """Cut once or twice, no slice is much larger than asked for, but for a value that is itself more frequent."""
    monkeypatch.setattr(quantiles, "FAN", 32)
    df = spark.range(40_000).select(F.when(F.col("id") % 5 == 0, -7.0).otherwise(F.col("id") * 7919 % 40_009).cast("double").alias("x"))
    edges = quantiles.cut_points(df, "x", slice_rows)
    sizes = counting.add_bin(df, "x", edges, "slice").filter("x >= 0").groupBy("slice").count().collect()
    assert len(sizes) >= 32_000 / most and max(r["count"] for r in sizes) <= most
    monkeypatch.setattr(curves, "cut_points", lambda *x: edges)
    found = sorted(curves.ecdf(df, "x").collect())
    assert found[0]["cdf"] == 0.2 and found[-1]["cdf"] == 1 and len(found) == 32_001
    assert all(a["cdf"] < b["cdf"] for a, b in zip(found, found[1:]))
