"""Distances of splits of the test tables, worked out beforehand."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tidemark import Settings, compare, fit_baseline


def split(spark, table, reference, current, shift=None, **settings):
    df = spark.read.parquet(f"{SF}/{table}.parquet")
    settings = Settings(exact_quantiles=True, metrics_numeric=[], metrics_categorical=[], **settings)
    after = df.filter(current)
    if shift:
        after = after.withColumns({name: F.expr(sql) for name, sql in shift.items()})
    baseline = fit_baseline(df.filter(reference), settings)
    (row,) = compare(after, baseline, settings).feature_metrics.collect()
    return row, baseline


SPLIT_DATE = "l_shipdate < DATE'1998-07-01'", "l_shipdate >= DATE'1998-07-01'"


@pytest.mark.parametrize(
    "shift, psi, js, hellinger, ks, chi",
    [
        (1.0, 0.000664, 0.000083, 0.009112, 0.008119, 0.000659),
        (1.3, 0.296220, 0.035499, 0.190368, 0.210903, 0.494593),
        (1.1, 0.058159, 0.007178, 0.084991, 0.082333, 0.076006),
    ],
)
def test_prices(spark, shift, psi, js, hellinger, ks, chi):
    row, _ = split(
        spark, "lineitem", *SPLIT_DATE, {"l_extendedprice": f"l_extendedprice * {shift}D"},
        numeric_features=["l_extendedprice"],
    )
    found = [row[m] for m in ("psi", "js", "hellinger", "ks_approx", "chi_square")]
    assert found == pytest.approx([psi, js, hellinger, ks, chi], abs=1e-6)


def test_prices_in_twelve_bins(spark):
    """With more than ten bins the running sums still follow the numeric order."""
    row, baseline = split(
        spark, "lineitem", *SPLIT_DATE, {"l_extendedprice": "l_extendedprice * 1.3D"},
        numeric_features=["l_extendedprice"], n_bins=12,
    )
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    edges = baseline.edges["l_extendedprice"][1:-1]
    sides = [
        df.filter(where).agg(*[F.avg((F.col("l_extendedprice") * by < e).cast("double")) for e in edges]).first()
        for where, by in zip(SPLIT_DATE, (1.0, 1.3))
    ]
    assert row["ks_approx"] == pytest.approx(max(abs(a - b) for a, b in zip(*sides)), abs=1e-4)


def test_values_going_missing(spark):
    row, _ = split(
        spark, "events", "ts < DATE'2024-01-16'", "ts >= DATE'2024-01-16'",
        {"value": "CASE WHEN event_id % 5 <> 0 THEN value END"}, numeric_features=["value"],
    )
    assert [row[m] for m in ("psi", "js", "hellinger", "ks_approx")] == pytest.approx(
        [2.489529, 0.075332, 0.324939, 0.199999], abs=1e-6
    )
    # the smallest expected share is raised to eps once more after rescaling
    assert row["chi_square"] == pytest.approx(39999.682671, rel=2e-6)


def test_document_lengths(spark):
    row, _ = split(spark, "documents", "lang = 'en'", "lang <> 'en'", numeric_features=["n_chars"])
    assert [row[m] for m in ("psi", "js", "hellinger", "ks_approx", "chi_square")] == pytest.approx(
        [0.102268, 0.012477, 0.112370, 0.043718, 0.083107], abs=1e-6
    )


@pytest.mark.parametrize(
    "table, feature, reference, current, top_k, psi, hellinger, chi, keys",
    [
        ("documents", "lang", "n_chars < 500", "n_chars >= 500", 50, 0.162423, 0.141818, 0.198758, 4),
        ("orders", "o_orderpriority", "o_orderpriority <> '1-URGENT'", "true", 50, 2.465776, 0.322968, 39415.166209, 4),
        ("part", "p_brand", "p_size <= 25", "p_size > 25", 50, 0.046313, 0.076004, 0.048134, 25),
        ("events", "props", "ts < DATE'2024-01-16'", "ts >= DATE'2024-01-16'", 20, 0.011530, 0.037927, 0.010163, 21),
    ],
)
def test_categories(spark, table, feature, reference, current, top_k, psi, hellinger, chi, keys):
    row, baseline = split(
        spark, table, reference, current, categorical_features=[feature], categorical_top_k=top_k
    )
    assert [row["psi"], row["hellinger"]] == pytest.approx([psi, hellinger], abs=1e-6)
    assert row["chi_square"] == pytest.approx(chi, rel=2e-6, abs=1e-6)
    assert baseline.known.count() == keys
    if feature == "o_orderpriority":
        assert row["new_category_share"] == 0.2 and row["severity"] == "critical"
