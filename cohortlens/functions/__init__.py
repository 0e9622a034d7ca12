"""Column expressions: no function here touches a DataFrame or runs Python per row."""

from .durations import elapsed_days, elapsed_seconds, full_years
from .labels import bin_numeric, bucket_text, code_labels, keep_levels, level_rank, number_from_text
from .text import count_percent, fixed_point, median_iqr_text, title_case

__all__ = [
    "bin_numeric",
    "bucket_text",
    "code_labels",
    "count_percent",
    "elapsed_days",
    "elapsed_seconds",
    "fixed_point",
    "full_years",
    "keep_levels",
    "level_rank",
    "median_iqr_text",
    "number_from_text",
    "title_case",
]
