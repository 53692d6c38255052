import pytest

from tidemark import Settings


@pytest.mark.parametrize(
    "wrong",
    [
        dict(n_bins=1),
        dict(relative_error=0),
        dict(relative_error=1.5),
        dict(categorical_top_k=0),
        dict(eps=0),
        dict(dataset_drift_min_share=1.1),
        dict(dataset_drift_min_share=-0.1),
        dict(metrics_numeric=["psi", "nonsense"]),
        dict(psi_thresholds=(0.3, 0.1)),
        dict(bounded_thresholds=(0.1, 0.2)),
        dict(edge_policy="other"),
        dict(schema_policy="other"),
        dict(numeric_features=["a"], categorical_features=["a"]),
    ],
)
def test_wrong_settings_are_refused(wrong):
    with pytest.raises(ValueError):
        Settings(**wrong)


def test_defaults():
    s = Settings()
    assert s.numeric_features == () and s.categorical_features == ()
    assert (s.n_bins, s.relative_error, s.categorical_top_k) == (10, 0.01, 50)
    assert s.metrics_numeric == ("psi", "js", "hellinger", "ks_approx")
    assert s.metrics_categorical == ("psi", "js", "hellinger", "chi_square")
    assert s.dataset_drift_min_share == 0.30 and s.eps == 1e-6


def test_no_metrics_means_all_five():
    s = Settings(metrics_numeric=[], metrics_categorical=None)
    assert s.metrics_numeric == s.metrics_categorical == ("psi", "js", "hellinger", "ks_approx", "chi_square")


def test_primary_metric_is_psi_or_the_first():
    assert Settings(metrics_numeric=["js", "psi"]).primary_metric("numeric") == "psi"
    assert Settings(metrics_numeric=["js", "ks_approx", "js"]).primary_metric("numeric") == "js"


def test_coarse_error_warns():
    with pytest.warns(UserWarning):
        Settings(n_bins=10, relative_error=0.1)
