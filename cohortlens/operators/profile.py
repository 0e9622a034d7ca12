"""Distributions and quality checks of a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import level_rank
from ..sources.snapshot import scratch
from .quantiles import QUARTILES, value_counts, written_quantiles

#: number of partial sums that :func:`with_total` brings together, a power of two
SLOTS = 64


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(100 * part / whole, digits)


def with_total(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Attach the sum of ``n`` over all rows as ``_total``.

    Rows are first summed per slot, so the one-task step sees ``SLOTS`` rows however
    many keys there are, and only those are broadcast.
    """
    slotted = counts.withColumn("_slot", F.xxhash64(key).bitwiseAND(SLOTS - 1))
    per_slot = slotted.groupBy("_slot").agg(F.sum(n).alias("_part"))
    everything = Window.partitionBy()
    totals = per_slot.select("_slot", F.sum("_part").over(everything).alias("_total"))
    return slotted.join(F.broadcast(totals), "_slot").drop("_slot")


def frequency(
    df: DataFrame, col: str, levels: Sequence[str] | None = None, by_count: bool = False
) -> DataFrame:
    """``col, n, pct`` per value; the percent is of all rows, missing values included.

    Sorted by count (ties by value), else by level order, else by value; missing
    last.
    """
    counts = with_total(df.groupBy(col).agg(F.count("*").alias("n")), col)
    result = counts.select(col, "n", percent(F.col("n"), F.col("_total")).alias("pct"))
    order = [F.col(col).asc_nulls_last()]
    if by_count:
        order.insert(0, F.desc("n"))
    elif levels:
        order.insert(0, level_rank(col, levels).asc_nulls_last())
    return result.orderBy(*order)


def _present(df: DataFrame, col: str) -> Column:
    """The column, with NaN as NULL."""
    return F.nanvl(F.col(col), F.lit(None)) if dict(df.dtypes).get(col) in ("double", "float") else F.col(col)


def numeric_profile(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """One row: min, q25, median, q75, max, mean, sd, n, n_missing of a column.

    ``n`` counts the values present; NaN counts as missing. Rows are counted by value in
    one pass, which runs when this is called; all statistics come from the counts.
    """
    counts = scratch(value_counts(df, [], [col], keep_missing=True), "counts")
    value, n = F.col("value"), F.col("n")
    known = F.when(value.isNotNull(), n).otherwise(0)
    mean = counts.agg((F.sum(value * n) / F.sum(F.when(value.isNotNull(), n))).alias("mean")).first()["mean"]
    middle = F.lit(mean).cast("double")
    squares = F.sum((value - middle) * (value - middle) * n)
    spread = F.sqrt(F.try_divide(squares, F.sum(known) - 1))
    stats = {
        "min": F.min(value),
        "max": F.max(value),
        "mean": F.round(middle, digits),
        "sd": F.when(F.sum(known) > 1, F.round(spread, digits)),
        "n": F.coalesce(F.sum(known), F.lit(0)),
        "n_missing": F.coalesce(F.sum(n - known), F.lit(0)),
    }
    merged = counts.agg(*[stat.alias(name) for name, stat in stats.items()])
    merged = merged.unionByName(written_quantiles(counts, []), True)
    profile = merged.agg(*[F.max(c).alias(c) for c in merged.columns])
    return profile.select("min", *QUARTILES, "max", "mean", "sd", "n", "n_missing")


def missing_profile(
    df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = True
) -> DataFrame:
    """``variable, n_missing, pct`` from one pass over all columns; NaN counts as missing."""
    cols = list(cols or df.columns)
    counted = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(_present(df, c).isNull()).alias(c) for c in cols]
    )
    long = counted.unpivot(["_rows"], cols, "variable", "n_missing")
    result = long.select(
        "variable",
        "n_missing",
        # no rows, no percent
        F.when(F.col("_rows") > 0, percent(F.col("n_missing"), F.col("_rows"))).alias("pct"),
    )
    return result.where(F.col("n_missing") > 0) if only_missing else result


def event_rate(df: DataFrame, flag: str, digits: int = 2) -> DataFrame:
    """One row: ``n_events, n_total, pct``; the percent is of rows with a known flag."""
    return df.agg(
        F.sum(flag).cast("long").alias("n_events"),
        F.count("*").alias("n_total"),
        F.round(100 * F.avg(flag), digits).alias("pct"),
    )


def _duration_columns(col: str) -> list[Column]:
    return [
        F.min(col).alias(f"min_{col}"),
        F.max(col).alias(f"max_{col}"),
        F.round(F.avg(col), 1).alias(f"mean_{col}"),
        F.count_if(F.col(col) < 0).alias(f"negative_{col}"),
    ]


def _presence_columns(col: str) -> list[Column]:
    absent = F.col(col).isNull() | (F.col(col) == 0)
    return [
        F.count_if(F.col(col) > 0).alias(f"with_{col}"),
        F.count_if(absent).alias(f"without_{col}"),
    ]


def _cap_columns(col: str, cap: int) -> list[Column]:
    return [
        F.min(col).alias(f"min_{col}"),
        F.max(col).alias(f"max_{col}"),
        F.count_if(F.col(col) == cap).alias(f"at_cap_{col}"),
    ]


def duration_checks(df: DataFrame, col: str) -> DataFrame:
    """One row: min, max, mean and number of negative values."""
    return df.agg(*_duration_columns(col))


def presence_checks(df: DataFrame, col: str) -> DataFrame:
    """One row: rows with a positive value, and with none or zero."""
    return df.agg(*_presence_columns(col))


def cap_checks(df: DataFrame, col: str, cap: int) -> DataFrame:
    """One row: min, max and number of values at the cap."""
    return df.agg(*_cap_columns(col, cap))


def range_checks(df: DataFrame, durations: Sequence[str], capped: str, cap: int) -> DataFrame:
    """All range checks in one pass: every duration column and one capped column."""
    columns = [c for d in durations for c in (*_duration_columns(d), *_presence_columns(d))]
    return df.agg(*columns, *_cap_columns(capped, cap))
