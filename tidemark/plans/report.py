"""From distances to a report: severities, ranking, advice, and the verdict for the table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import severity as s
from ..functions.values import share
from ..settings import EXTRA_METRICS, METRICS, Settings

FEATURE_TYPES = ("numeric", "categorical")


@dataclass(frozen=True)
class Report:
    feature_metrics: DataFrame
    dataset_summary: DataFrame
    recommendations: DataFrame

    def show(self, n: int = 20, truncate: bool | int = False) -> None:
        for title, table in (
            ("Feature metrics", self.feature_metrics),
            ("Dataset summary", self.dataset_summary),
            ("Recommendations", self.recommendations),
        ):
            print(title)
            table.show(n, truncate=truncate)

    def order_by_severity(self) -> DataFrame:
        return self.feature_metrics.orderBy(*_by_rank())

    def drifted_features(self) -> DataFrame:
        return self.feature_metrics.filter("drift_detected").orderBy(*_by_rank())


def feature_metrics(measured: DataFrame, settings: Settings) -> DataFrame:
    """One row per feature with its severity, rank and advice.

    measured: feature, feature_type, all distances, new_category_share, missing_ref, missing_cur and
    schema_issue. Thresholds are applied to unrounded values.
    """
    metrics = {t: settings.metrics_for(t) for t in FEATURE_TYPES}
    extra = [m for m in EXTRA_METRICS if any(m in names for names in metrics.values())]
    primary = {t: settings.primary_metric(t) for t in FEATURE_TYPES}

    rows = (
        measured.withColumns(
            {
                "missing_delta": F.expr("missing_cur - missing_ref"),
                "levels": _by_type(lambda t: s.metric_levels(metrics[t], settings)),
                "primary_value": _by_type(lambda t: primary[t]),
                "primary_level": _by_type(lambda t: s.metric_level(primary[t], primary[t], settings)),
            }
        )
        .withColumn(
            "severity_score",
            F.expr(s.escalate(s.consensus_level("primary_level", "levels"), "new_category_share", "schema_issue")),
        )
        .select(
            F.col("feature").alias("feature_name"),
            "feature_type",
            _by_type(lambda t: f"'{primary[t]}'").alias("primary_metric"),
            "primary_value",
            *[_if_requested(m, metrics).alias(m) for m in [*METRICS, *extra]],
            F.expr(s.label("severity_score")).alias("severity"),
            "severity_score",
            F.expr(f"severity_score > {s.NONE}").alias("drift_detected"),
            F.expr(s.rank_score("severity_score", "levels", settings.use_metric_consensus)).alias("rank_score"),
            "missing_ref",
            "missing_cur",
            "missing_delta",
            "new_category_share",
            s.advice_text(s.advice_code("severity_score", "missing_delta", "new_category_share")).alias(
                "recommendation"
            ),
        )
    )
    # one row per feature: a window over all of them is as small as the schema
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*_by_rank())))


def dataset_summary(features: DataFrame, min_share: float) -> DataFrame:
    return (
        features.selectExpr(
            "count(*) AS total_features",
            "count_if(drift_detected) AS drifted_features",
            f"count_if(severity_score >= {s.HIGH}) AS high_or_critical_features",
        )
        .withColumn(
            "drift_share", F.coalesce(share(F.col("drifted_features"), F.col("total_features")), F.lit(0.0))
        )
        .withColumn("dataset_drift", F.col("drift_share") >= F.lit(min_share))
        .withColumn(
            "dataset_severity",
            F.expr(s.dataset_label("high_or_critical_features", "dataset_drift", "drift_share")),
        )
    )


def build_report(features: DataFrame, settings: Settings) -> Report:
    return Report(
        feature_metrics=features,
        dataset_summary=dataset_summary(features, settings.dataset_drift_min_share),
        recommendations=features.select("rank", "feature_name", "severity", "rank_score", "recommendation"),
    )


def _by_rank() -> list[Column]:
    return [F.col("severity_score").desc(), F.col("rank_score").desc(), F.col("feature_name")]


def _by_type(make: Callable[[str], str]) -> Column:
    return F.expr(
        f"CASE WHEN feature_type = 'numeric' THEN {make('numeric')} ELSE {make('categorical')} END"
    )


def _if_requested(metric: str, metrics: dict[str, Sequence[str]]) -> Column:
    return _by_type(lambda t: metric if metric in metrics[t] else "CAST(NULL AS DOUBLE)")
