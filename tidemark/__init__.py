"""Distribution-change monitoring on Spark: profile a baseline, compare tables with it."""

from .plans.monitor import Baseline, Monitor, compare, fit_baseline, profile_table
from .plans.report import Report
from .plans.validation import Validation, validate
from .settings import Settings
from .sources.tables import TableStore

__all__ = [
    "Baseline",
    "Monitor",
    "Report",
    "Settings",
    "TableStore",
    "Validation",
    "compare",
    "fit_baseline",
    "profile_table",
    "validate",
]
