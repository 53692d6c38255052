import itertools
import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidemark import Monitor, Settings, compare, fit_baseline
from tidemark.functions import severity as s
from tidemark.plans.report import dataset_summary, feature_metrics

SCHEMA = (
    "feature string, feature_type string, psi double, js double, hellinger double, ks_approx double, "
    "chi_square double, linf double, missing_ref double, missing_cur double, new_category_share double, "
    "schema_issue boolean"
)
GRID = {"psi": (None, 0.0999, 0.1, 0.25), "js": (0.0, 0.05, 0.1, 0.2), "hellinger": (0.0499, 0.1, 0.2), "ks_approx": (0.0, 0.3)}


def measured(spark, rows):
    full = [
        {**dict(feature_type="numeric", psi=0.0, js=0.0, hellinger=0.0, ks_approx=0.0, chi_square=0.0, linf=0.0,
                missing_ref=0.0, missing_cur=0.0, new_category_share=0.0, schema_issue=False), **row}
        for row in rows
    ]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in full], SCHEMA)


def by_name(df):
    return {r["feature_name"]: r for r in df.collect()}


def plain_level(metric, value):
    if value is None:
        return 0
    if metric == "psi":
        return 0 if value < 0.1 else 2 if value < 0.25 else 3
    if metric in ("js", "hellinger", "ks_approx"):
        return sum(value >= bound for bound in (0.05, 0.1, 0.2))
    return 0


def test_severity_and_rank_score_over_a_grid(spark):
    rows, wanted = [], {}
    for i, values in enumerate(itertools.product(*GRID.values())):
        row = dict(zip(GRID, values), feature=f"f{i}")
        rows.append(row)
        levels = [plain_level(m, row[m]) for m in GRID]
        level = levels[0]
        if sum(x >= 3 for x in levels) >= 2:
            level = 3
        elif sum(x >= 2 for x in levels) >= 2:
            level = max(level, 2)
        wanted[row["feature"]] = (level, level * (1 + sum(x >= 2 for x in levels) / 4))
    found = by_name(feature_metrics(measured(spark, rows), Settings()))
    for name, (level, score) in wanted.items():
        assert found[name]["severity_score"] == level
        assert found[name]["severity"] == s.LABELS[level]
        assert found[name]["drift_detected"] == (level > 0)
        assert found[name]["rank_score"] == pytest.approx(score)
    order = sorted(found.values(), key=lambda r: (-r["severity_score"], -r["rank_score"], r["feature_name"]))
    assert [r["rank"] for r in order] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("share, level", [(0.0, 0), (0.0999, 0), (0.1, 3), (0.1999, 3), (0.2, 4), (1 / 5, 4)])
def test_new_categories_escalate(spark, share, level):
    rows = [dict(feature="c", feature_type="categorical", new_category_share=share)]
    (row,) = feature_metrics(measured(spark, rows), Settings()).collect()
    assert row["severity_score"] == level


def test_schema_issue_is_critical(spark):
    (row,) = feature_metrics(measured(spark, [dict(feature="x", schema_issue=True)]), Settings()).collect()
    assert row["severity"] == "critical"


def test_requested_metrics_and_primary(spark):
    settings = Settings(metrics_numeric=["hellinger", "linf"], metrics_categorical=["chi_square", "psi"])
    rows = [dict(feature="n", hellinger=0.3, linf=0.4, psi=9.0), dict(feature="c", feature_type="categorical", psi=0.3, js=0.9)]
    found = by_name(feature_metrics(measured(spark, rows), settings))
    n, c = found["n"], found["c"]
    assert (n["primary_metric"], n["primary_value"], n["psi"], n["linf"]) == ("hellinger", 0.3, None, 0.4)
    assert (n["severity"], n["rank_score"]) == ("high", 3 * 1.5)
    assert (c["primary_metric"], c["primary_value"], c["js"], c["linf"]) == ("psi", 0.3, None, None)
    assert (c["severity"], c["rank_score"]) == ("high", 3 * 1.5)
    # a column for linf appears only on request
    assert "linf" not in feature_metrics(measured(spark, rows), Settings()).columns


def test_consensus_off_clears_the_score_not_the_severity(spark):
    rows = [dict(feature="x", js=0.3, hellinger=0.3)]
    (row,) = feature_metrics(measured(spark, rows), Settings(use_metric_consensus=False)).collect()
    assert (row["severity"], row["rank_score"]) == ("high", 0.0)


@pytest.mark.parametrize(
    "row, code",
    [
        (dict(schema_issue=True), "act_now"),
        (dict(psi=0.25), "find_cause"),
        (dict(psi=0.1), "monitor"),
        (dict(js=0.06, psi=None), "nothing"),
        (dict(missing_cur=0.06), "check_missing"),
        (dict(missing_ref=0.06), "check_missing"),
        (dict(missing_cur=0.05), "nothing"),
        (dict(feature_type="categorical", new_category_share=0.05), "check_new_categories"),
        (dict(feature_type="categorical", new_category_share=0.05, missing_cur=0.2), "check_missing"),
        (dict(missing_cur=None), "nothing"),
    ],
)
def test_advice(spark, row, code):
    (found,) = feature_metrics(measured(spark, [dict(feature="x", **row)]), Settings()).collect()
    assert found["recommendation"] == s.ADVICE[code]


def test_low_severity_comes_from_another_primary_metric(spark):
    settings = Settings(metrics_numeric=["js"])
    (row,) = feature_metrics(measured(spark, [dict(feature="x", js=0.06)]), settings).collect()
    assert (row["severity"], row["recommendation"]) == ("low", s.ADVICE["keep_history"])


@pytest.mark.parametrize(
    "levels, min_share, wanted",
    [
        ([], 0.3, (0, 0, 0, 0.0, False, "none")),
        ([0, 0], 0.3, (2, 0, 0, 0.0, False, "none")),
        ([0, 0], 0.0, (2, 0, 0, 0.0, True, "medium")),
        ([2, 0, 0, 0], 0.3, (4, 1, 0, 0.25, False, "low")),
        ([2, 2, 0, 0], 0.5, (4, 2, 0, 0.5, True, "medium")),
        ([3, 0, 0, 0, 0], 0.3, (5, 1, 1, 0.2, False, "high")),
        ([4], 0.3, (1, 1, 1, 1.0, True, "high")),
    ],
)
def test_dataset_summary(spark, levels, min_share, wanted):
    features = spark.createDataFrame(
        [(x, x > 0) for x in levels], "severity_score int, drift_detected boolean"
    )
    (row,) = dataset_summary(features, min_share).collect()
    assert tuple(row) == wanted


# ---- whole comparisons


def one(spark, reference, current, **settings):
    given = dict(numeric_features=["x"], n_bins=4)
    settings = Settings(**{**given, **settings})
    baseline = fit_baseline(reference, settings)
    return by_name(compare(current, baseline, settings).feature_metrics)


def column(spark, sql, n=100):
    return spark.range(n).selectExpr(f"{sql} AS x")


def test_identical_tables_have_no_distance(spark):
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    settings = Settings(infer_features=True, metrics_numeric=[], metrics_categorical=[])
    report = compare(df, fit_baseline(df, settings), settings)
    rows = report.feature_metrics.collect()
    assert len(rows) == 10
    for row in rows:
        for m in ("psi", "js", "hellinger", "ks_approx", "chi_square"):
            assert row[m] == pytest.approx(0, abs=1e-9)
    assert report.dataset_summary.collect()[0]["dataset_severity"] == "none"


def test_constant_that_stays_and_constant_that_spreads(spark):
    constant = column(spark, "5.0D")
    assert one(spark, constant, constant)["x"]["psi"] == pytest.approx(0)
    spread = one(spark, constant, column(spark, "CAST(id AS DOUBLE)"))["x"]
    assert spread["severity"] == "high" and spread["psi"] > 5


def test_numbers_that_all_go_missing(spark):
    row = one(spark, column(spark, "CAST(id AS DOUBLE)"), column(spark, "CAST(NULL AS DOUBLE)"))["x"]
    assert row["severity"] == "high" and row["missing_delta"] == 1.0


def test_numbers_that_appear_in_an_empty_column(spark):
    row = one(spark, column(spark, "CAST(NULL AS DOUBLE)"), column(spark, "CAST(id AS DOUBLE)"))["x"]
    assert row["severity"] == "high" and row["missing_delta"] == -1.0


def test_two_valued_column_by_edge_policy(spark):
    reference, current = column(spark, "CAST(id % 2 AS INT)"), column(spark, "CAST(id % 10 = 0 AS INT)")
    assert one(spark, reference, current)["x"]["psi"] == pytest.approx(0)
    assert one(spark, reference, current, edge_policy="extend_ends")["x"]["severity"] == "high"


def test_empty_current_table(spark):
    df = spark.range(10).selectExpr("id AS x", "CAST(id AS STRING) AS c")
    found = one(spark, df, df.filter(F.lit(False)), categorical_features=["c"])
    for row in found.values():
        assert row["psi"] is None and row["primary_value"] is None
        assert row["missing_cur"] is None and row["missing_delta"] is None
        assert (row["severity"], row["rank_score"], row["recommendation"]) == ("none", 0.0, s.ADVICE["nothing"])


def test_empty_reference_table(spark):
    df = spark.range(10).selectExpr("id AS x", "CAST(id AS STRING) AS c")
    found = one(spark, df.filter(F.lit(False)), df, categorical_features=["c"])
    assert {r["psi"] for r in found.values()} == {None}
    assert found["x"]["severity"] == "none"


def test_missing_column(spark):
    reference = spark.range(10).selectExpr("id AS x", "id AS y", "CAST(id AS STRING) AS c")
    settings = dict(numeric_features=["x", "y"], categorical_features=["c"])
    found = one(spark, reference, reference.drop("y", "c"), **settings)
    for name in ("y", "c"):
        assert found[name]["severity"] == "critical" and found[name]["psi"] is None and found[name]["missing_cur"] is None
    assert found["x"]["severity"] == "none"
    ignored = one(spark, reference, reference.drop("y", "c"), schema_policy="ignore", **settings)
    assert ignored.keys() == {"x"}


def test_changed_type(spark):
    reference = spark.range(10).selectExpr("id AS x")
    wider = reference.selectExpr("CAST(x AS DOUBLE) AS x")
    row = one(spark, reference, wider)["x"]
    assert row["severity"] == "critical" and row["psi"] == pytest.approx(0)
    assert one(spark, reference, wider, schema_policy="ignore")["x"]["severity"] == "none"

    text = reference.selectExpr("CAST(x AS STRING) AS x")
    row = one(spark, reference, text)["x"]
    assert row["severity"] == "critical" and row["psi"] is None
    with pytest.raises(ValueError):
        one(spark, reference, text, schema_policy="ignore")


def test_features_are_those_found_at_fit(spark):
    df = spark.range(10).selectExpr("id AS x", "CAST(id AS STRING) AS c")
    settings = Settings(infer_features=True, schema_policy="ignore")
    baseline = fit_baseline(df, settings)
    current = df.selectExpr("x", "c", "id AS extra") if "id" in df.columns else df.withColumn("extra", F.lit(1))
    assert by_name(compare(current, baseline, settings).feature_metrics).keys() == {"x", "c"}


def test_unusual_column_names(spark):
    df = spark.range(20).selectExpr("id AS `a.b c`", "CAST(id % 3 AS STRING) AS `x``y`", "id AS `it's`")
    settings = Settings(infer_features=True)
    found = by_name(compare(df, fit_baseline(df, settings), settings).feature_metrics)
    assert found.keys() == {"a.b c", "x`y", "it's"}
    assert all(r["psi"] == pytest.approx(0) for r in found.values())


def test_repeated_features_count_once(spark):
    df = spark.range(20).selectExpr("id AS x")
    settings = Settings(numeric_features=["x", "x"])
    assert len(compare(df, fit_baseline(df, settings), settings).feature_metrics.collect()) == 1


def test_schema_changes_against_the_baseline(spark):
    df = spark.range(5).selectExpr("id AS x", "id AS y", "id AS z")
    monitor = Monitor(Settings(numeric_features=["x"]), spark).fit(df)
    found = monitor.schema_changes(df.selectExpr("x", "CAST(y AS INT) AS y", "1 AS w"))
    assert {r["feature"]: r["status"] for r in found.collect()} == {
        "w": "UNEXPECTED", "x": "OK", "y": "TYPE_CHANGED", "z": "MISSING",
    }


def test_compare_before_fit(spark):
    monitor = Monitor(Settings(numeric_features=["x"]), spark)
    with pytest.raises(RuntimeError):
        monitor.compare(spark.range(1))
    with pytest.raises(RuntimeError):
        monitor.save_baseline("/nowhere")


def test_monitor_finds_the_active_session(spark):
    assert Monitor(Settings()).spark is not None


def test_no_features(spark):
    with pytest.raises(ValueError):
        fit_baseline(spark.range(1), Settings())


def test_psi_of_a_known_pair(spark):
    reference, current = column(spark, "CAST(id % 4 AS DOUBLE)"), column(spark, "CAST(id % 2 AS DOUBLE)")
    row = one(spark, reference, current, edge_policy="extend_ends")["x"]
    e = 1e-6
    assert row["psi"] == pytest.approx(2 * 0.25 * math.log(2) + 2 * (0.25 - e) * math.log(0.25 / e), rel=1e-4)
