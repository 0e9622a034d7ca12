"""Elapsed time between zone-less timestamps.

``timestampdiff`` and ``months_between`` first cast TIMESTAMP_NTZ to the session
time zone, which moves clock times that fall into a daylight-saving gap. Plain
subtraction of NTZ values does not, so everything here is built on it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECONDS_PER_DAY = 86400
MICROS = 1_000_000
#: one year in calendar numbers, whose digits are yyyymmdd times a day's microseconds
YEAR_STEP = 10_000 * SECONDS_PER_DAY * MICROS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def elapsed_seconds(start: Column | str, end: Column | str) -> Column:
    """Seconds from start to end as an exact decimal; may be negative."""
    return (_col(end) - _col(start)).cast("decimal(18,6)")


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    """Fractional days, NULL when the end lies before the start."""
    start, end = _col(start), _col(end)
    days = elapsed_seconds(start, end).cast("double") / F.lit(float(SECONDS_PER_DAY))
    return F.when(end >= start, days)


def _calendar_number(at: Column) -> Column:
    """A number that grows with time and by the same step for every calendar year."""
    date = (F.year(at) * 100 + F.month(at)) * 100 + F.dayofmonth(at)
    midnight = at.cast("date").cast("timestamp_ntz")
    micros = F.floor(elapsed_seconds(midnight, at).cast("double") * MICROS + 0.5)
    return date.cast("long") * (SECONDS_PER_DAY * MICROS) + micros


def full_years(dob: Column | str, at: Column | str, cap: int | None = None) -> Column:
    """Completed years from ``dob`` to ``at``, truncated towards zero.

    A value above ``cap`` becomes ``cap``; a missing one stays missing.
    """
    dob, at = _col(dob), _col(at)
    passed = _calendar_number(at) - _calendar_number(dob)
    years = F.call_function("div", passed, F.lit(YEAR_STEP))
    if cap is None:
        return years
    # least() skips NULL and would turn a missing age into the cap
    return F.when(dob.isNotNull() & at.isNotNull(), F.least(years, F.lit(cap).cast("long")))
