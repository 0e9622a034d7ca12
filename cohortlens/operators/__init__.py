"""DataFrame operators: each takes frames and column names and returns a lazy frame."""

from .crosstab import crosstab
from .exposures import (
    ExposureColumns,
    dominant_value,
    dose_by_unit,
    dose_units_used,
    exposure_detail,
    exposure_overview,
    exposures_with_units,
    setting_split,
    top_exposures,
    unit_totals,
)
from .flags import flag_by_codes, left_flags
from .intervals import flag_in_interval, total_interval_days
from .profile import (
    cap_checks,
    duration_checks,
    event_rate,
    frequency,
    missing_profile,
    numeric_profile,
    presence_checks,
    range_checks,
)
from .quantiles import quantiles, value_counts
from .strata import outcomes_by

__all__ = [
    "ExposureColumns",
    "cap_checks",
    "crosstab",
    "dominant_value",
    "dose_by_unit",
    "dose_units_used",
    "duration_checks",
    "event_rate",
    "exposure_detail",
    "exposure_overview",
    "exposures_with_units",
    "flag_by_codes",
    "flag_in_interval",
    "frequency",
    "left_flags",
    "missing_profile",
    "numeric_profile",
    "outcomes_by",
    "presence_checks",
    "quantiles",
    "range_checks",
    "setting_split",
    "top_exposures",
    "total_interval_days",
    "unit_totals",
    "value_counts",
]
