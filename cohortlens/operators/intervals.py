"""Intervals per key: total length, and whether an event falls inside one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.durations import SECONDS_PER_DAY, elapsed_seconds

NO_DAY = "0001-01-01"
#: number of places over which the events of a key without a time are spread
UNTIMED = 4096


def total_interval_days(
    intervals: DataFrame, key: str, start: str, end: str, name: str = "total_days"
) -> DataFrame:
    """Summed length per key in days; NULL when the sum is negative or has no term.

    Open intervals are skipped by the sum. The sign is tested on the sum, not on
    each interval. Seconds are added as exact decimals, so order does not matter.
    """
    total = F.sum(elapsed_seconds(start, end))
    days = total.cast("double") / F.lit(float(SECONDS_PER_DAY))
    return intervals.groupBy(key).agg(F.when(total >= 0, days).alias(name))


def flag_in_interval(
    events: DataFrame,
    intervals: DataFrame,
    key: str,
    at: str,
    start: str,
    end: str,
    flag: str = "in_interval",
    only: DataFrame | None = None,
) -> DataFrame:
    """Add a 0/1 column: does ``at`` lie in some interval of its key, bounds included?

    Rows are never multiplied; a missing key, time or bound never matches. With ``only``,
    a frame of keys, events of other keys are dropped.

    An event is inside exactly if the latest end among the intervals of its key that began
    no later reaches it. That is a running maximum over events and starts in time order,
    so no event is compared with an interval. It is scanned on two levels: within an hour
    of a key, and over the maxima of the key's earlier hours, which a small table carries
    over. A key that holds a large part of all rows is spread over its hours.
    """
    kept = events if only is None else events.join(only.select(key), key, "left_semi")
    by_hour = _events_and_starts(kept, intervals, key, at, start, end)
    hour = [key, "_day", "_hour"]
    up_to_here = Window.partitionBy(*hour).orderBy("_at", "_is_event").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    scanned = by_hour.withColumn("_latest", F.max("_reach").over(up_to_here)).where("_is_event = 1")
    joined = scanned.join(_carried_over(by_hour, hour), hour, "left")
    inside = F.greatest("_latest", "_before") >= F.col("_at")
    return joined.select(*events.columns, F.when(inside, 1).otherwise(0).alias(flag))


def _events_and_starts(events, intervals, key, at, start, end) -> DataFrame:
    """Events and interval starts in one frame, dealt out by key and hour.

    Columns: those of the events (NULL on starts, but for the key), ``_at``,
    ``_is_event``, ``_reach`` (end of the interval, NULL on events), ``_day``, ``_hour``.
    """
    time = dict(events.dtypes)[at]
    moments = events.withColumns(
        {"_at": F.col(at), "_is_event": F.lit(1), "_reach": F.lit(None).cast(time)}
    )
    starts = intervals.where((F.col(end) >= F.col(start)) & F.col(key).isNotNull()).select(
        F.col(key),
        F.col(start).cast(time).alias("_at"),
        F.lit(0).alias("_is_event"),
        F.col(end).cast(time).alias("_reach"),
    )
    # no comparison holds for events without a time, so any hour will do for them
    anywhere = F.pmod(F.xxhash64(*events.columns), F.lit(UNTIMED)).cast("int")
    return (
        moments.unionByName(starts, allowMissingColumns=True)
        .withColumns(
            {
                "_day": F.coalesce(F.col("_at").cast("date"), F.lit(NO_DAY).cast("date")),
                "_hour": F.coalesce(F.hour("_at"), anywhere),
            }
        )
        .repartition(key, "_day", "_hour")
    )


def _carried_over(by_hour: DataFrame, hour: list[str]) -> DataFrame:
    """Per hour of a key: the latest end of intervals that began in an earlier hour.

    ``_seen`` looks at every column, so that this branch asks for the same rows as the
    other one and both share one evaluation and one shuffle of them.
    """
    per_hour = by_hour.groupBy(*hour).agg(
        F.max("_reach").alias("_reach"), F.max(F.xxhash64(*by_hour.columns)).alias("_seen")
    )
    key, *time = hour
    earlier = Window.partitionBy(key).orderBy(*time).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_hour.withColumn("_before", F.max("_reach").over(earlier))
    return carried.where(F.col("_seen").isNotNull()).select(*hour, "_before")
