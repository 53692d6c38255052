import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark import Settings
from tidemark.operators import features, schema_diff
from tidemark.sources.tables import literal_table


def test_inference_by_type(spark):
    df = spark.sql(
        "SELECT 1 AS a, 'x' AS b, true AS c, DATE'2024-01-01' AS d, array(1) AS e, 1.5BD AS f, "
        "TIMESTAMP'2024-01-01 00:00:00' AS g, map('k', 1) AS h, named_struct('z', 1) AS i, X'00' AS j"
    )
    assert features.infer_features(df) == (["a", "f"], ["b", "c"])


def test_inference_fills_only_empty_lists(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS b, 'x' AS c, 'y' AS d")
    assert features.resolve_features(df, Settings(infer_features=True)) == (["a", "b"], ["c", "d"])
    assert features.resolve_features(df, Settings(numeric_features=["b"], infer_features=True)) == (["b"], ["c", "d"])
    assert features.resolve_features(df, Settings(numeric_features=["b"])) == (["b"], [])
    # a numeric column watched as categories is not watched twice
    assert features.resolve_features(df, Settings(categorical_features=["a"], infer_features=True)) == (["b"], ["a"])


def test_missing_features_are_listed(spark):
    with pytest.raises(ValueError, match="'q', 'r'"):
        features.require_features(spark.sql("SELECT 1 AS a"), ["a", "q"], ["r"])


def test_schema_changes(spark):
    before = schema_diff.schema_table(spark, {"a": "int", "b": "string", "c": "double"})
    after = schema_diff.schema_table(spark, {"b": "int", "c": "double", "d": "date"})
    assert rows(schema_diff.schema_changes(before, after)) == [
        dict(feature="a", status="MISSING", reference_type="int", current_type=None),
        dict(feature="b", status="TYPE_CHANGED", reference_type="string", current_type="int"),
        dict(feature="c", status="OK", reference_type="double", current_type="double"),
        dict(feature="d", status="UNEXPECTED", reference_type=None, current_type="date"),
    ]
    assert schema_diff.compare_schemas({"a": "int", "b": "string"}, {"b": "int", "d": "date"}) == {
        "missing_columns": ["a"],
        "unexpected_columns": ["d"],
        "type_changes": ["b"],
    }


def test_column_quality(spark):
    before = spark.createDataFrame([(1, "x"), (None, "y")], "a int, b string")
    after = spark.createDataFrame([(1.0, None, 1), (2.0, None, 2)], "a double, b string, c int")
    assert rows(schema_diff.column_quality(before, after)) == [
        dict(feature="a", status="TYPE_CHANGED", reference_type="int", current_type="double",
             missing_ref=0.5, missing_cur=0.0, missing_delta=-0.5),
        dict(feature="b", status="OK", reference_type="string", current_type="string",
             missing_ref=0.0, missing_cur=1.0, missing_delta=1.0),
    ]


def test_quality_of_empty_and_of_unlike_tables(spark):
    full = spark.createDataFrame([(1,)], "a int")
    (row,) = rows(schema_diff.column_quality(full, full.filter(F.lit(False))))
    assert row["missing_ref"] == 0.0 and row["missing_cur"] is None and row["missing_delta"] is None
    unlike = schema_diff.column_quality(full, spark.createDataFrame([(1,)], "z int"))
    assert unlike.collect() == []
    assert unlike.schema == literal_table(spark, [], schema_diff.QUALITY_SCHEMA).schema


def test_null_rates_of_a_wide_table(spark):
    wide = spark.range(4).select(*[F.when(F.col("id") < i % 5, 1).alias(f"c.{i}") for i in range(150)])
    found = {r["feature"]: r["null_rate"] for r in schema_diff.null_rates(wide).collect()}
    assert found == {f"c.{i}": 1 - (i % 5) / 4 for i in range(150)}


def test_nan_is_not_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    assert schema_diff.null_rates(df).collect()[0]["null_rate"] == 0.5
