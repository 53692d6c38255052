"""The small worked-out example: five rows on each side, six columns."""

import pytest

from tidemark import Monitor, Settings

# The rows of the example.
COLUMNS = ["idade", "renda", "score", "uf", "segmento", "canal"]
REFERENCE = [
    (25, 3000.0, 700.0, "DF", "PF", "APP"),
    (30, 5000.0, 720.0, "DF", "PF", "APP"),
    (42, 9000.0, 760.0, "SP", "PJ", "WEB"),
    (35, 7000.0, 740.0, "DF", "PF", "APP"),
    (50, 12000.0, 800.0, "SP", "PJ", "AGENCIA"),
]
CURRENT = [
    (26, 10000.0, 680.0, "DF", "PF", "APP"),
    (31, 15000.0, 690.0, "SP", "PJ", "WEB"),
    (45, 20000.0, 700.0, "SP", "PJ", "WEB"),
    (39, 18000.0, 710.0, "RJ", "MPE", "APP"),
    (52, 25000.0, 720.0, "RJ", "PJ", "AGENCIA"),
]

# psi, js, hellinger, ks_approx, chi_square, new_category_share, severity, rank_score
GOLDEN = {
    "segmento": (2.961740, 0.131701, 0.404036, None, 39999.966668, 1 / 3, "critical", 7.0),
    "uf": (5.599119, 0.190948, 0.502949, None, 159999.466667, 1 / 3, "critical", 7.0),
    "renda": (7.873377, 0.274339, 0.605148, 0.599997, None, 0.0, "high", 6.0),
    "score": (8.432651, 0.304303, 0.631602, 0.599998, None, 0.0, "high", 6.0),
    "canal": (0.219722, 0.027058, 0.165104, None, 0.266667, 0.0, "medium", 3.0),
    "idade": (0.0, 0.0, 0.0, 0.0, None, 0.0, "none", 0.0),
}

FEATURE_METRICS = (
    "feature_name string, feature_type string, primary_metric string, primary_value double, psi double, js double, "
    "hellinger double, ks_approx double, chi_square double, severity string, severity_score int, "
    "drift_detected boolean, rank_score double, missing_ref double, missing_cur double, missing_delta double, "
    "new_category_share double, recommendation string, rank int"
)
SUMMARY = (
    "total_features bigint, drifted_features bigint, high_or_critical_features bigint, drift_share double, "
    "dataset_drift boolean, dataset_severity string"
)
RECOMMENDATIONS = "rank int, feature_name string, severity string, rank_score double, recommendation string"


def ddl(df):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


@pytest.fixture(scope="module", params=[False, True], ids=["sketch", "exact"])
def report(request, spark):
    settings = Settings(
        numeric_features=COLUMNS[:3], categorical_features=COLUMNS[3:], exact_quantiles=request.param
    )
    monitor = Monitor(settings, spark).fit(spark.createDataFrame(REFERENCE, COLUMNS))
    return monitor.compare(spark.createDataFrame(CURRENT, COLUMNS))


def test_feature_metrics(report):
    found = {r["feature_name"]: r for r in report.feature_metrics.collect()}
    assert found.keys() == GOLDEN.keys()
    for rank, (name, (psi, js, hellinger, ks, chi, new, severity, score)) in enumerate(GOLDEN.items(), 1):
        row = found[name]
        assert row["primary_metric"] == "psi" and row["primary_value"] == row["psi"]
        for metric, wanted in (("psi", psi), ("js", js), ("hellinger", hellinger), ("ks_approx", ks), ("chi_square", chi)):
            assert row[metric] == (None if wanted is None else pytest.approx(wanted, abs=1e-6)), (name, metric)
        assert row["new_category_share"] == pytest.approx(new)
        assert (row["severity"], row["rank_score"], row["rank"]) == (severity, score, rank)
        assert (row["missing_ref"], row["missing_cur"], row["missing_delta"]) == (0, 0, 0)


def test_summary(report):
    (row,) = report.dataset_summary.collect()
    assert tuple(row) == (6, 5, 4, pytest.approx(5 / 6), True, "high")


def test_schemas(report):
    assert ddl(report.feature_metrics) == FEATURE_METRICS
    assert ddl(report.dataset_summary) == SUMMARY
    assert ddl(report.recommendations) == RECOMMENDATIONS


def test_views(report, capsys):
    assert [r["feature_name"] for r in report.order_by_severity().collect()] == list(GOLDEN)
    assert [r["feature_name"] for r in report.drifted_features().collect()] == list(GOLDEN)[:-1]
    report.show()
    assert "renda" in capsys.readouterr().out
