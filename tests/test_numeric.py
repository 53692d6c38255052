import math
from math import inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from tidemark import Settings, profile_table
from tidemark.operators import counting, quantiles
from tidemark.plans.profiling import numeric_histogram


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def plain_bin(v, edges):
    if v is None or math.isnan(v):
        return -1
    for i in range(len(edges) - 1):
        if edges[i] <= v < edges[i + 1] or (i == len(edges) - 2 and v == edges[i + 1]):
            return i
    return -1


@pytest.mark.parametrize(
    "edges",
    [[-inf, inf], [-inf, 2.0, inf], [-inf, 0.0, 2.0, 2.5, inf], [0.0, 1.0, 2.0], [1.0, 2.0]],
)
def test_bins_of_special_values(spark, edges):
    values = [None, nan, -inf, inf, -0.0, 0.0, 1.0, 1.999, 2.0, 2.4999, 2.5, 1e300, -1e300]
    found = counting.add_bin(numbers(spark, values), "x", edges).collect()
    assert [r["bin"] for r in found] == [plain_bin(v, edges) for v in values]


def test_bins_accept_any_column_name(spark):
    df = numbers(spark, [1.0, 3.0], "`a.b c`")
    assert [r["bin"] for r in counting.add_bin(df, "a.b c", [-inf, 2.0, inf]).collect()] == [0, 1]
    assert [r["n"] for r in counting.numeric_counts(df, {"a.b c": [-inf, 2.0, inf]}).collect()] == [1, 1]


def test_edges():
    assert quantiles.bin_edges([]) == [-inf, inf]
    assert quantiles.bin_edges([0.0, 0.0, 1.0]) == [-inf, inf]
    assert quantiles.bin_edges([0.0, 1.0], "extend_ends") == [-inf, 0.0, 1.0, inf]
    assert quantiles.bin_edges([1.0, 1.0, 2.0, 3.0, 3.0, 5.0]) == [-inf, 2.0, 3.0, inf]
    assert quantiles.bin_edges([5.0, 5.0]) == [-inf, 5.0, math.nextafter(5.0, inf), inf]
    assert quantiles.bin_edges([inf, inf]) == [-inf, inf]


def test_quantiles_leave_out_null_and_nan(spark):
    df = numbers(spark, [None, nan, 3.0, 1.0, 2.0, 4.0, inf])
    for exact in (False, True):
        assert quantiles.quantile_vectors(df, ["x"], 4, 0.01, exact) == {"x": [1.0, 2.0, 3.0, 4.0, inf]}


def test_quantiles_without_numbers(spark):
    df = numbers(spark, [None, nan])
    for exact in (False, True):
        assert quantiles.quantile_vectors(df, ["x"], 4, 0.01, exact) == {"x": []}


def test_exact_quantiles_against_numpy(spark):
    generator = np.random.default_rng(3)
    # a third of the rows share one value
    values = np.concatenate([generator.normal(size=4000), np.full(2000, 0.25)])
    df = numbers(spark, values.tolist()).repartition(7)
    found = quantiles.quantile_vectors(df, ["x"], 20, 0.01, exact=True)["x"]
    wanted = np.quantile(values, np.arange(21) / 20, method="inverted_cdf")
    assert found == wanted.tolist()


def test_sketch_error_holds(spark):
    error, n_bins = 0.02, 10
    df = spark.range(0, 40_000, numPartitions=16).select(
        (F.col("id") * F.col("id") % 39_989).cast("double").alias("a"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id")).cast("double").alias("b"),
    )
    found = quantiles.quantile_vectors(df, ["a", "b"], n_bins, error)
    table = df.toPandas()
    for name, q in found.items():
        values = np.sort(table[name].to_numpy())
        assert q[0] == values[0] and q[-1] == values[-1] and q == sorted(q)
        for i, v in enumerate(q):
            low, high = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            slack = len(values) * error + 1
            assert low - slack <= i / n_bins * len(values) <= high + slack, (name, i)


def test_exact_quantiles_narrow_slices_that_are_too_large(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FAN", 8)
    monkeypatch.setattr(quantiles, "FAN_ERROR", 1 / 32)
    generator = np.random.default_rng(8)
    table = {"a": generator.normal(size=9000), "b": np.where(generator.random(9000) < 0.4, 3.0, generator.random(9000)), "c": np.zeros(9000)}
    df = spark.createDataFrame([tuple(map(float, row)) for row in zip(*table.values())], "a double, b double, c double").repartition(5)
    rounds = []
    narrowed = quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda *x: rounds.append(1) or narrowed(*x))
    found = {r["feature"]: r["quantiles"] for r in quantiles.exact_quantiles(df, list(table), 7, slice_rows=40).collect()}
    assert len(rounds) >= 2
    for name, values in table.items():
        assert found[name] == np.quantile(values, np.arange(8) / 7, method="inverted_cdf").tolist()


def test_merged_sketches_are_those_of_all_rows(spark, tmp_path):
    df = spark.range(30_000).select((F.col("id") * 7919 % 30_011).cast("double").alias("x"), F.lit(None).cast("int").alias("none"))
    parts = [quantiles.quantile_sketches(df.filter(f"x % 3 = {i}"), ["x", "none"], 0.01) for i in range(3)]
    parts[0].write.parquet(f"{tmp_path}/s")
    merged = quantiles.merged_sketches(spark.read.parquet(f"{tmp_path}/s"), *parts[1:])
    (row,) = quantiles.sketch_quantiles(merged, 10).collect()
    values = np.sort(df.toPandas()["x"].to_numpy())
    assert merged.first()["n"] == 30_000 and row["quantiles"][0] == values[0] and row["quantiles"][-1] == values[-1]
    for i, v in enumerate(row["quantiles"]):
        assert abs(np.searchsorted(values, v) - i * 3000) <= 301


def test_sketches_have_a_limit():
    with pytest.raises(ValueError, match="exact_quantiles"):
        quantiles.sketch_size(1e-5)


def test_histogram_counts_missing_numbers_in_the_whole(spark):
    df = numbers(spark, [1.0, 2.0, nan, None])
    assert rows(numeric_histogram(df, {"x": [-inf, 1.5, inf]})) == [
        dict(feature="x", ord=-1, n=2, p=0.5),
        dict(feature="x", ord=0, n=1, p=0.25),
        dict(feature="x", ord=1, n=1, p=0.25),
    ]


def test_profile_of_numbers(spark):
    df = numbers(spark, [1.0, 2.0, nan, None])
    (row,) = profile_table(df, Settings(numeric_features=["x"], n_bins=2)).collect()
    # NaN is a value for the counts and the largest one, but belongs to the bin without a number
    assert (row["count"], row["total_count"], row["null_count"], row["null_proportion"]) == (3, 4, 1, 0.25)
    assert row["min"] == 1.0 and math.isnan(row["max"])
    assert row["quantiles"] == [1.0, 1.0, 2.0] and row["bin_edges"] == [-inf, inf]
    assert [(b["kind"], b["key"], b["ord"], b["n"]) for b in row["bins"]] == [("bin", "-1", -1, 2), ("bin", "0", 0, 2)]


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "x double, c string")
    found = rows(profile_table(df, Settings(numeric_features=["x"], categorical_features=["c"])))
    for row in found:
        assert (row["count"], row["total_count"], row["null_count"], row["null_proportion"]) == (0, 0, 0, 0.0)
        assert row["bins"] == []
    assert found[0]["cardinality"] in (0, None)


def test_all_numeric_types(spark):
    df = spark.sql(
        "SELECT CAST(id AS TINYINT) a, CAST(id AS SMALLINT) b, CAST(id AS INT) c, id d, "
        "CAST(id AS FLOAT) e, CAST(id AS DOUBLE) f, CAST(id AS DECIMAL(20,2)) g FROM range(100)"
    )
    found = profile_table(df, Settings(infer_features=True)).collect()
    assert len(found) == 7
    for row in found:
        assert (row["min"], row["max"], row["count"]) == (0.0, 99.0, 100)
        assert [b["n"] for b in row["bins"]] == [b["n"] for b in found[0]["bins"]]


def test_many_columns_are_counted(spark):
    wide = spark.range(100).select(*[(F.col("id") + i).cast("double").alias(f"c{i}") for i in range(70)])
    found = profile_table(wide, Settings(infer_features=True)).collect()
    assert sorted(r["feature_name"] for r in found) == sorted(f"c{i}" for i in range(70))
    assert all(sum(b["n"] for b in r["bins"]) == 100 for r in found)


def test_text_column_named_as_numeric_is_refused(spark):
    df = spark.createDataFrame([("a",)], "x string")
    with pytest.raises(ValueError, match="another type"):
        profile_table(df, Settings(numeric_features=["x"]))
