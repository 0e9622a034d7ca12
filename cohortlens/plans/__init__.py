"""The study itself: cohort, exposures and the four report tables."""

from .cohort import build_cohort, label_cohort, split_cohort
from .exposures import build_exposures
from .report import (
    ReportConfig,
    demographics,
    freeze_report,
    outcomes,
    present_demographics,
    present_exposures,
    present_outcomes,
    present_report,
    report_tables,
    top_exposures_report,
)
from .titles import Titles, titled, titles_of
from .views import create_views, view_checks

__all__ = [
    "ReportConfig",
    "Titles",
    "build_cohort",
    "build_exposures",
    "create_views",
    "demographics",
    "freeze_report",
    "label_cohort",
    "outcomes",
    "present_demographics",
    "present_exposures",
    "present_outcomes",
    "present_report",
    "report_tables",
    "split_cohort",
    "titled",
    "titles_of",
    "top_exposures_report",
    "view_checks",
]
