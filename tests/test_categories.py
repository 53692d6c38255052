from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark import Settings, compare, fit_baseline, profile_table
from tidemark.operators import categories, counting
from tidemark.plans.monitor import counts_on_baseline


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "c string")


def bins(baseline_or_profile):
    (row,) = baseline_or_profile.collect()
    return [(b["kind"], b["key"], b["n"]) for b in row["bins"]]


def test_top_k_and_other(spark):
    df = texts(spark, ["b"] * 3 + ["a"] * 3 + ["c"] * 2 + [None] * 2 + ["d"])
    profile = profile_table(df, Settings(categorical_features=["c"], categorical_top_k=3))
    # ties by key, null before text
    assert bins(profile) == [("value", "a", 3), ("value", "b", 3), ("missing", "__MISSING__", 2), ("other", "__OTHER__", 3)]
    (row,) = profile.collect()
    assert (row["count"], row["total_count"], row["null_count"], row["cardinality"]) == (9, 11, 2, 5)


def test_no_other_when_everything_is_listed(spark):
    assert bins(profile_table(texts(spark, ["a", "b"]), Settings(categorical_features=["c"]))) == [
        ("value", "a", 1),
        ("value", "b", 1),
    ]


def test_rare_categories(spark):
    df = texts(spark, ["a"] * 500 + ["r2"] * 2 + ["r1"] * 2 + ["r0"])
    rare = fit_baseline(df, Settings(categorical_features=["c"])).rare
    assert rows(rare.select("category", "n")) == [dict(category="r0", n=1), dict(category="r1", n=2), dict(category="r2", n=2)]


def test_all_rare_and_new_categories_are_listed(spark):
    df = spark.range(10_000).selectExpr("CAST(id % 5000 AS STRING) AS c")
    baseline = fit_baseline(df, Settings(categorical_features=["c"]))
    assert baseline.rare.count() == 5000 and baseline.profile.first()["cardinality"] == 5000
    assert categories.new_categories(texts(spark, ["x"]), df, ["c"]).count() == 5000
    first = categories.new_categories(texts(spark, ["x"]), df, ["c"], listed=3)
    assert sorted(r["category"] for r in first.collect()) == ["0", "1", "10"]


def test_labels_as_ordinary_values_stay_apart(spark):
    reference = texts(spark, ["__OTHER__"] * 4 + ["__MISSING__"] * 3 + [None] * 2 + ["x"])
    settings = Settings(categorical_features=["c"], categorical_top_k=3)
    baseline = fit_baseline(reference, settings)
    assert bins(baseline.profile) == [
        ("value", "__OTHER__", 4),
        ("value", "__MISSING__", 3),
        ("missing", "__MISSING__", 2),
        ("other", "__OTHER__", 1),
    ]
    counts = {(r["kind"], r["key"]): r["n"] for r in counts_on_baseline(texts(spark, [None, "y", "__OTHER__"]), baseline).collect()}
    assert counts == {("missing", "__MISSING__"): 1, ("other", "__OTHER__"): 1, ("value", "__OTHER__"): 1}
    (row,) = compare(reference, baseline, settings).feature_metrics.collect()
    assert row["psi"] == 0 and row["severity"] == "none"


@pytest.mark.parametrize("reference", [["a", "a", "b", None], ["a", "b", "c"], [None]])
def test_both_ways_of_projection_agree(spark, reference):
    settings = Settings(categorical_features=["c"], categorical_top_k=2)
    baseline = fit_baseline(texts(spark, reference), settings)
    current = texts(spark, ["a", "a", "z", None, None, "b"])
    found = [
        rows(categories.projected_counts(current, baseline.known, ["c"], lists))
        for lists in (baseline.known_lists, None)
    ]
    assert found[0] == found[1]
    assert sum(r["n"] for r in found[0]) == 6 and sum(r["n_valued"] for r in found[0]) == 4


def test_known_categories_may_be_joined(spark):
    settings = Settings(categorical_features=["c"], known_in_scan=False)
    baseline = fit_baseline(texts(spark, ["a", "a", "b"]), settings)
    assert baseline.known_lists is None
    (row,) = compare(texts(spark, ["a", "b", "n"]), baseline, settings).feature_metrics.collect()
    assert row["new_category_share"] == pytest.approx(1 / 3)


def test_booleans_and_dates_as_categories(spark):
    df = spark.sql("SELECT true AS b, DATE'2024-01-02' AS d UNION ALL SELECT NULL, NULL")
    counts = counting.category_counts(df, ["b", "d"])
    assert Counter((r["feature"], r["kind"], r["key"]) for r in counts.collect()) == Counter(
        [("b", "value", "true"), ("b", "missing", None), ("d", "value", "2024-01-02"), ("d", "missing", None)]
    )


def test_new_categories(spark):
    found = categories.new_categories(
        texts(spark, ["a", "b"]), texts(spark, ["a", "n", "n", None, "m"]), ["c"]
    )
    assert rows(found) == [
        dict(feature="c", category="__MISSING__", n=1),
        dict(feature="c", category="m", n=1),
        dict(feature="c", category="n", n=2),
    ]
    none = categories.new_categories(texts(spark, ["a", None]), texts(spark, [None, "a"]), ["c"])
    assert none.collect() == []


def test_new_category_share_ends_once_reference_has_other(spark):
    settings = Settings(categorical_features=["c"], categorical_top_k=1)
    baseline = fit_baseline(texts(spark, ["a", "a", "b"]), settings)
    (row,) = compare(texts(spark, ["a", "n"]), baseline, settings).feature_metrics.collect()
    assert row["new_category_share"] == 0.0


def test_a_hot_category_is_one_row_per_task(spark):
    df = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("c")
    )
    settings = Settings(categorical_features=["c"], categorical_top_k=5)
    (row,) = profile_table(df, settings).collect()
    assert (row["bins"][0]["key"], row["bins"][0]["n"]) == ("hot", 33334)
    assert row["cardinality"] == 66667 and row["bins"][-1]["n"] == 66666 - 4
