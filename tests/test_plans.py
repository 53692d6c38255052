"""What the plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidemark import Settings, fit_baseline
from tidemark.operators import categories, counting, curves, divergence, quantiles, schema_diff
from tidemark.plans.monitor import counts_on_baseline, measured_features
from tidemark.plans.profiling import categorical_profile

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus", "l_linenumber"]


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")


def final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def read_schemas(plan):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


def no_pairing_of_all_rows(plan):
    return "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_categorical_profile_scans_and_shuffles_the_rows_once(lineitem):
    plan = final_plan(categorical_profile(lineitem, CATEGORICAL, 2))
    assert len(read_schemas(plan)) == 1
    assert "ReusedExchange" in plan and "WindowGroupLimit" in plan
    assert no_pairing_of_all_rows(plan)


def test_counting_reads_only_its_columns_and_aggregates_before_the_shuffle(lineitem):
    df = lineitem.filter("l_shipdate < DATE'1998-07-01'")
    plan = final_plan(counting.numeric_counts(df, {x: [float("-inf"), 1.0, 2.0, float("inf")] for x in NUMERIC[:2]}))
    (columns,) = read_schemas(plan)
    assert set(re.findall(r"l_\w+", columns)) == {"l_quantity", "l_extendedprice", "l_shipdate"}
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_count" in plan


def test_compare_reads_each_column_once_and_shuffles_only_known_keys(lineitem):
    settings = Settings(numeric_features=NUMERIC, categorical_features=["l_comment"], categorical_top_k=5)
    # a text without repeats as a category
    unique = lineitem.withColumn("l_comment", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    baseline = fit_baseline(unique, settings)
    counts = counts_on_baseline(unique, baseline)
    assert counts.filter("feature_type = 'categorical'").count() <= 6
    plan = final_plan(measured_features(unique, baseline, settings))
    read = [set(re.findall(r"\bl_\w+", x)) for x in read_schemas(plan)]
    lineitem_scans = [x for x in read if x]
    assert len(lineitem_scans) == 2 and not lineitem_scans[0] & lineitem_scans[1]
    assert no_pairing_of_all_rows(plan)
    assert "Python" not in plan


def test_new_categories_take_one_shuffle_of_the_categories(lineitem):
    found = categories.new_categories(lineitem.filter("l_tax < 0.05"), lineitem, ["l_orderkey", "l_returnflag"])
    plan = final_plan(found)
    assert "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_curves_pair_no_rows(lineitem):
    for df in (
        curves.ks_exact(lineitem.filter("l_tax < 0.05"), lineitem, "l_quantity"),
        curves.ecdf(lineitem, "l_extendedprice"),
        curves.density_curve(lineitem, "l_extendedprice"),
        curves.density_histogram(lineitem, "l_extendedprice"),
        schema_diff.column_quality(lineitem, lineitem.drop("l_tax")),
    ):
        plan = final_plan(df)
        assert no_pairing_of_all_rows(plan) and "Python" not in plan


def test_any_number_of_columns_takes_one_scan_of_each_kind(spark, tmp_path):
    names = [f"c{i}" for i in range(40)]
    spark.range(500).select(*[(F.col("id") * (i + 1) % 17).alias(x) for i, x in enumerate(names)]).write.parquet(f"{tmp_path}/wide")
    wide = spark.read.parquet(f"{tmp_path}/wide")
    edges = {x: [float("-inf"), 3.0, 9.0, float("inf")] for x in names}
    known = {x: {"value": ["1", "5"], "missing": []} for x in names}
    for found in (
        counting.numeric_counts(wide, edges),
        counting.category_counts(wide, names),
        counting.known_category_counts(wide, known),
        counting.category_counts_of_two(wide, wide, names),
        quantiles.sketched_quantiles(wide, names, 4, 0.05),
        schema_diff.null_rates(wide, names + names),
    ):
        plan = final_plan(found)
        # rows of two tables are two scans
        assert plan.count("FileScan parquet") == (2 if "n_ref" in found.columns else 1) and "Python" not in plan
        assert found.select("feature").distinct().count() == 40
