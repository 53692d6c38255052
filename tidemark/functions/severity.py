"""Severity, rank score and advice as SQL expressions over column names.

Levels are integers until the last step. The rules are long chains of cases, which read best, and
are handed to Spark fastest, as SQL text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Severity labels by level, and the shares of new categories that escalate.
LABELS = ("none", "low", "medium", "high", "critical")
NONE, LOW, MEDIUM, HIGH, CRITICAL = range(5)
NEW_CATEGORY_HIGH = 0.10
NEW_CATEGORY_CRITICAL = 0.20
MISSING_DELTA_NOTABLE = 0.05

BOUNDED_METRICS = ("js", "hellinger", "ks_approx")

ADVICE = {
    "act_now": "Look into this at once: the structure or the distribution of the column has changed strongly.",
    "find_cause": "Find the cause and measure the effect on the model before recalibrating or retraining.",
    "monitor": "Keep watching the column and check whether the model's quality measures move with it.",
    "keep_history": "Follow it over time; on its own this asks for no intervention.",
    "check_missing": "Check the data quality: the share of missing values has changed notably.",
    "check_new_categories": "Watch the new categories and check what changed in the process that fills the column.",
    "nothing": "No action needed.",
}


def metric_level(metric: str, value: str, settings) -> str:
    """Level of one metric value; lower bounds belong to the higher level, null counts as none."""
    if metric == "psi":
        steps = list(zip(settings.psi_thresholds, (MEDIUM, HIGH)))
    elif metric in BOUNDED_METRICS:
        steps = list(zip(settings.bounded_thresholds, (LOW, MEDIUM, HIGH)))
    else:
        return str(NONE)
    cases = " ".join(f"WHEN {value} >= {_double(bound)} THEN {level}" for bound, level in reversed(steps))
    return f"CASE {cases} ELSE {NONE} END"


def metric_levels(metrics: Sequence[str], settings) -> str:
    """The levels of several metrics, each in the column of its name, as an array."""
    return f"array({', '.join(metric_level(m, m, settings) for m in metrics)})"


def count_at_least(levels: str, level: int) -> str:
    return f"size(filter({levels}, x -> x >= {level}))"


def consensus_level(primary: str, levels: str) -> str:
    """Two high metrics make the column high; two at medium or above make it at least medium."""
    return (
        f"CASE WHEN {count_at_least(levels, HIGH)} >= 2 THEN {HIGH} "
        f"WHEN {count_at_least(levels, MEDIUM)} >= 2 THEN greatest({primary}, {MEDIUM}) "
        f"ELSE {primary} END"
    )


def escalate(level: str, new_category_share: str, schema_issue: str) -> str:
    """Structural evidence outranks the distances."""
    return (
        f"CASE WHEN {schema_issue} OR {new_category_share} >= {_double(NEW_CATEGORY_CRITICAL)} THEN {CRITICAL} "
        f"WHEN {new_category_share} >= {_double(NEW_CATEGORY_HIGH)} THEN greatest({level}, {HIGH}) "
        f"ELSE {level} END"
    )


def label(level: str) -> str:
    names = ", ".join(f"'{x}'" for x in LABELS)
    return f"get(array({names}), {level})"


def rank_score(level: str, levels: str, use_consensus: bool) -> str:
    """Level, raised by the share of metrics at medium or above; 0 when consensus is off."""
    if not use_consensus:
        return "0D"
    return f"{level} * (1D + {count_at_least(levels, MEDIUM)} / CAST(size({levels}) AS DOUBLE))"


def advice_code(level: str, missing_delta: str, new_category_share: str) -> str:
    return (
        f"CASE WHEN {level} = {CRITICAL} THEN 'act_now' "
        f"WHEN {level} = {HIGH} THEN 'find_cause' "
        f"WHEN {level} = {MEDIUM} THEN 'monitor' "
        f"WHEN {level} = {LOW} THEN 'keep_history' "
        f"WHEN abs({missing_delta}) > {_double(MISSING_DELTA_NOTABLE)} THEN 'check_missing' "
        f"WHEN {new_category_share} > 0 THEN 'check_new_categories' "
        "ELSE 'nothing' END"
    )


def advice_text(code: str) -> Column:
    pairs = [F.lit(x) for item in ADVICE.items() for x in item]
    return F.element_at(F.create_map(*pairs), F.expr(code))


def dataset_label(high_or_critical: str, dataset_drift: str, drift_share: str) -> str:
    return (
        f"CASE WHEN {high_or_critical} > 0 THEN '{LABELS[HIGH]}' "
        f"WHEN {dataset_drift} THEN '{LABELS[MEDIUM]}' "
        f"WHEN {drift_share} > 0 THEN '{LABELS[LOW]}' "
        f"ELSE '{LABELS[NONE]}' END"
    )


def _double(x: float) -> str:
    return f"{x!r}D"
