"""Everything a comparison can be told, checked once when it is built."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

# Metric names and default settings that results depend on.
METRICS = ("psi", "js", "hellinger", "ks_approx", "chi_square")
EXTRA_METRICS = ("linf",)
NUMERIC_METRICS = ("psi", "js", "hellinger", "ks_approx")
CATEGORICAL_METRICS = ("psi", "js", "hellinger", "chi_square")
PSI_THRESHOLDS = (0.10, 0.25)
BOUNDED_THRESHOLDS = (0.05, 0.10, 0.20)

EDGE_POLICIES = ("replace_ends", "extend_ends")
SCHEMA_POLICIES = ("critical", "ignore")
NEW_CATEGORY_WEIGHTS = ("keys", "rows")


@dataclass(frozen=True)
class Settings:
    """Settings of one monitor.

    relative_error     rank error allowed for the quantiles that become bin edges
    exact_quantiles    take exact quantiles instead; one scan more
    edge_policy        'replace_ends' opens the outer edges to infinity, so the smallest and the
                       largest quantile are no edges of their own; 'extend_ends' keeps them as
                       inner edges, which makes a change in a two-valued column visible
    schema_policy      'critical' reports a watched column that is gone or has another type as
                       critical; 'ignore' leaves a column that is gone out of the report
    rare_threshold     categories below this share are listed as rare
    known_in_scan      test the baseline's categories while scanning, so that only they are shuffled; set it to
                       False for lists too long to be part of a plan: they are joined after counting
    new_category_weight  'keys' takes the share of new categories among the current table's, 'rows' the
                       share of its rows that hold one
    copy_watched       write the watched columns of a table to the shared folder first and read the copy, so that CSV
                       and other row formats are parsed once; the Monitor's close() deletes it
    max_inferred_cardinality  leave inferred categorical features with more values than this unwatched (identifiers,
                       free text), by an estimate within cardinality_error; features named in the settings stay
    cardinality_error  relative error of that estimate at three standard deviations
    """

    numeric_features: Sequence[str] | None = None
    categorical_features: Sequence[str] | None = None
    n_bins: int = 10
    relative_error: float = 0.01
    categorical_top_k: int = 50
    metrics_numeric: Sequence[str] | None = NUMERIC_METRICS
    metrics_categorical: Sequence[str] | None = CATEGORICAL_METRICS
    psi_thresholds: tuple[float, float] = PSI_THRESHOLDS
    bounded_thresholds: tuple[float, float, float] = BOUNDED_THRESHOLDS
    dataset_drift_min_share: float = 0.30
    eps: float = 1e-6
    infer_features: bool = False
    use_metric_consensus: bool = True
    rare_threshold: float = 0.01
    edge_policy: str = "replace_ends"
    schema_policy: str = "critical"
    exact_quantiles: bool = False
    known_in_scan: bool = True
    new_category_weight: str = "keys"
    copy_watched: bool = False
    max_inferred_cardinality: int | None = None
    cardinality_error: float = 0.05

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        put("numeric_features", tuple(dict.fromkeys(self.numeric_features or ())))
        put("categorical_features", tuple(dict.fromkeys(self.categorical_features or ())))
        put("metrics_numeric", requested_metrics(self.metrics_numeric))
        put("metrics_categorical", requested_metrics(self.metrics_categorical))
        put("psi_thresholds", _ascending("psi_thresholds", self.psi_thresholds, 2))
        put("bounded_thresholds", _ascending("bounded_thresholds", self.bounded_thresholds, 3))

        _require(self.n_bins >= 2, "n_bins must be at least 2")
        _require(0 < self.relative_error <= 1, "relative_error must lie in (0, 1]")
        _require(self.categorical_top_k >= 1, "categorical_top_k must be at least 1")
        _require(self.eps > 0, "eps must be positive")
        _require(0 <= self.dataset_drift_min_share <= 1, "dataset_drift_min_share must lie in [0, 1]")
        _require(0 <= self.rare_threshold <= 1, "rare_threshold must lie in [0, 1]")
        _require(self.edge_policy in EDGE_POLICIES, f"edge_policy must be one of {EDGE_POLICIES}")
        _require(self.schema_policy in SCHEMA_POLICIES, f"schema_policy must be one of {SCHEMA_POLICIES}")
        _require(
            self.new_category_weight in NEW_CATEGORY_WEIGHTS, f"new_category_weight must be one of {NEW_CATEGORY_WEIGHTS}"
        )
        _require(0.0022 <= self.cardinality_error < 1, "cardinality_error must lie in [0.0022, 1)")
        limit = self.max_inferred_cardinality
        _require(limit is None or limit >= 1, "max_inferred_cardinality must be at least 1")
        both = set(self.numeric_features) & set(self.categorical_features)
        _require(not both, f"features listed as numeric and as categorical: {sorted(both)}")
        if not self.exact_quantiles and self.relative_error >= 1 / self.n_bins:
            warnings.warn("relative_error reaches 1 / n_bins: the lowest bin edges fall together", stacklevel=3)

    def metrics_for(self, feature_type: str) -> tuple[str, ...]:
        return self.metrics_numeric if feature_type == "numeric" else self.metrics_categorical

    def primary_metric(self, feature_type: str) -> str:
        """The population stability index where it is asked for, else the first metric asked for."""
        names = self.metrics_for(feature_type)
        return "psi" if "psi" in names else names[0]


def requested_metrics(names: Sequence[str] | None) -> tuple[str, ...]:
    """Metric names without repeats, in the order given; none given means the five standard ones."""
    unique = tuple(dict.fromkeys(names or METRICS))
    unknown = [n for n in unique if n not in METRICS + EXTRA_METRICS]
    _require(not unknown, f"unknown metrics: {unknown}")
    return unique


def _ascending(name: str, values: Sequence[float], size: int) -> tuple[float, ...]:
    values = tuple(float(v) for v in values)
    _require(len(values) == size, f"{name} needs {size} values")
    _require(list(values) == sorted(values), f"{name} must be ascending")
    return values


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)
