"""Outcomes over several stratifications in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..sources.snapshot import scratch
from .quantiles import QUARTILES, value_counts, written_quantiles

STRATUM = ["stratifier", "stratum"]


def outcomes_by(
    df: DataFrame,
    strata: Mapping[str, str],
    measures: Sequence[str],
    flag: str,
    keep_null: bool = False,
) -> DataFrame:
    """Quartiles of every measure and the rate of ``flag`` per stratum.

    ``strata`` maps a title to a column. Output: ``stratifier, stratum, n``, per
    measure ``<measure>_q25, _median, _q75``, and ``<flag>_pct``. Rows without a
    stratum are left out of that stratification unless ``keep_null``.

    Values are counted once per combination of strata, and GROUPING SETS roll the
    counts, not the rows, up to each stratification. Counting runs when this is called.
    """
    # every row has the measure _row, so the counts of known values also count rows
    counted = df.withColumn("_row", F.lit(1))
    counts = value_counts(counted, list(strata.values()), [*measures, flag, "_row"])
    rolled = scratch(_roll_up(counts, strata, keep_null), "counts")
    mean = F.sum(F.col("value") * F.col("n")) / F.sum("n")
    per_measure = rolled.groupBy(*STRATUM, "measure").agg(
        F.sum("n").alias("_known"), mean.alias("_mean")
    )
    spread = written_quantiles(rolled.where(F.col("measure").isin(*measures)), [*STRATUM, "measure"])
    return _one_row_per_stratum(per_measure.unionByName(spread, True), measures, flag)


def _title_and_stratum(grouped: DataFrame, strata: Mapping[str, str], keep_null: bool) -> DataFrame:
    """Name each grouping set; grouping() tells a NULL stratum from a rolled-up column."""
    title, stratum = F, F
    for name, column in strata.items():
        in_set = F.col(f"_{column}_out") == 0
        title = title.when(in_set, F.lit(name))
        stratum = stratum.when(in_set, F.col(column).cast("string"))
    kept = [c for c in grouped.columns if c not in strata.values() and not c.endswith("_out")]
    named = grouped.select(title.alias("stratifier"), stratum.alias("stratum"), *kept)
    return named if keep_null else named.where(F.col("stratum").isNotNull())


def _roll_up(counts: DataFrame, strata: Mapping[str, str], keep_null: bool) -> DataFrame:
    """``stratifier, stratum, measure, value, n`` for every stratification."""
    columns = list(strata.values())
    sets = [[F.col(c), F.col("measure"), F.col("value")] for c in columns]
    grouped = counts.groupingSets(sets, *columns, "measure", "value").agg(
        F.sum("n").alias("n"), *[F.grouping(c).alias(f"_{c}_out") for c in columns]
    )
    return _title_and_stratum(grouped, strata, keep_null)


def _one_row_per_stratum(long: DataFrame, measures: Sequence[str], flag: str) -> DataFrame:
    of = lambda measure, column: F.max(F.when(F.col("measure") == measure, F.col(column)))
    wide = [of("_row", "_known").alias("n")]
    wide += [of(m, q).alias(f"{m}_{q}") for m in measures for q in QUARTILES]
    wide.append(F.round(100 * of(flag, "_mean"), 1).alias(f"{flag}_pct"))
    return long.groupBy(*STRATUM).agg(*wide)
