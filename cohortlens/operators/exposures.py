"""Summaries of an exposure table: one row per exposure event of a case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import number_from_text
from ..sources.snapshot import scratch
from .profile import percent
from .quantiles import written_quantiles


@dataclass(frozen=True)
class ExposureColumns:
    """Which column holds what: the thing given, to whom, how much of which unit, and 0/1 inside."""

    name: str = "drug"
    entity: str = "hadm_id"
    dose: str = "dose_val_rx"
    unit: str = "dose_unit_rx"
    inside: str = "in_icu"


DRUGS = ExposureColumns()


def exposure_overview(df: DataFrame, count_null: bool = False, cols: ExposureColumns = DRUGS) -> DataFrame:
    """One row: exposures, entities and distinct names.

    ``count_null`` counts a missing key as one more value. Rows are counted per (entity,
    name) first, so the two distinct counts see each pair once.
    """
    pairs = df.groupBy(cols.entity, cols.name).agg(F.count("*").alias("_n"))
    sides = pairs.groupingSets([[F.col(cols.entity)], [F.col(cols.name)]], cols.entity, cols.name).agg(
        F.grouping(cols.name).alias("_of_entity"), F.sum("_n").alias("_n")
    )
    of_entity = F.col("_of_entity") == 1
    counts = lambda side, col: F.count_if(side if count_null else side & F.col(col).isNotNull())
    return sides.agg(
        F.coalesce(F.sum(F.when(of_entity, F.col("_n"))), F.lit(0)).alias("total_prescriptions"),
        counts(of_entity, cols.entity).alias("n_admissions"),
        counts(~of_entity, cols.name).alias("n_unique_drugs"),
    )


def _by_count(name: str, n: str = "n_prescriptions") -> list[Column]:
    """Most frequent first; equal counts in name order, a missing name last."""
    return [F.desc(n), F.col(name).asc_nulls_last()]


def top_exposures(df: DataFrame, k: int, cols: ExposureColumns = DRUGS) -> DataFrame:
    """The ``k`` most frequent names with counts, mean dose, share inside, rate per entity.

    Rows are first counted per (name, entity), so a very frequent name is spread over
    its entities. The grand total comes from the same pass, as one more group that
    sorts first, and meets the others when only ``k + 1`` rows are left.
    """
    leading = _totals(df, cols).orderBy(F.desc("_all"), *_by_count(cols.name)).limit(k + 1)
    whole = F.max(F.when(F.col("_all") == 1, F.col("n_prescriptions"))).over(Window.partitionBy())
    ranked = leading.withColumn("_total", whole).where(F.col("_all") == 0)
    n = F.col("n_prescriptions")
    return ranked.select(
        cols.name,
        n,
        "n_admissions",
        F.round(F.col("_dose_sum") / F.col("_doses"), 2).alias("mean_dose"),
        F.round(100 * F.col("_inside") / n, 1).alias("pct_in_icu"),
        F.round(F.try_divide(n, F.col("n_admissions")), 2).alias("per_admission"),
        percent(n, F.col("_total")).alias("pct_of_total"),
    )


def _totals(df: DataFrame, cols: ExposureColumns = DRUGS) -> DataFrame:
    dose = number_from_text(cols.dose)
    pairs = df.groupBy(cols.name, cols.entity).agg(
        F.count("*").alias("_n"),
        F.sum(dose).alias("_dose_sum"),
        F.count(dose).alias("_doses"),
        F.sum(cols.inside).alias("_inside"),
    )
    sums = [F.sum(c).alias(c) for c in ("_dose_sum", "_doses", "_inside")]
    return pairs.groupingSets([[F.col(cols.name)], []], cols.name).agg(
        F.grouping(cols.name).alias("_all"),
        F.sum("_n").alias("n_prescriptions"),
        F.count(cols.entity).alias("n_admissions"),
        *sums,
    )


def exposure_detail(df: DataFrame, k: int, cols: ExposureColumns = DRUGS) -> DataFrame:
    """Counts, share inside and rate per entity of the ``k`` most frequent names.

    One grouped query in place of a filter per name.
    """
    wanted = [cols.name, "n_prescriptions", "n_admissions", "pct_in_icu", "per_admission"]
    return top_exposures(df, k, cols).select(*wanted)


def dominant_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value, n``: the most frequent value per key.

    A missing value counts as a value; equal counts go to the smaller one, missing
    last.
    """
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return _first_per_key(counts, key, value, "n").select(key, value, "n")


def _first_per_key(df: DataFrame, key: str, value: str, n: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(n), F.col(value).asc_nulls_last())
    return df.withColumn("_place", F.row_number().over(order)).where(F.col("_place") == 1).drop("_place")


def unit_totals(df: DataFrame, cols: ExposureColumns = DRUGS) -> DataFrame:
    """Totals per name and per (name, unit).

    ``per_unit`` is 1 on rows of a (name, unit) pair and 0 on rows of a name. Rows are
    counted once per (name, unit, entity), so a very frequent name is spread over its
    entities and both kinds of totals add up the same counts.
    """
    dose = number_from_text(cols.dose)
    counts = df.groupBy(cols.name, cols.unit, cols.entity).agg(
        F.count("*").alias("_n"),
        F.sum(dose).alias("_dose_sum"),
        F.count(dose).alias("_doses"),
        F.sum(cols.inside).alias("_inside"),
        F.count(cols.inside).alias("_settings"),
    )
    parts = ["_n", "_dose_sum", "_doses", "_inside", "_settings"]
    added = [F.sum(c).alias(c) for c in parts]
    per_unit = counts.groupBy(cols.name, cols.unit).agg(*added, F.count(cols.entity).alias("n_admissions"))
    of_entity = counts.groupBy(cols.name, cols.entity).agg(*added)
    per_name = of_entity.groupBy(cols.name).agg(*added, F.count(cols.entity).alias("n_admissions"))
    both = per_unit.withColumn("per_unit", F.lit(1)).unionByName(
        per_name.withColumn("per_unit", F.lit(0)), allowMissingColumns=True
    )
    return both.select(
        cols.name,
        cols.unit,
        "per_unit",
        F.col("_n").alias("n_prescriptions"),
        "n_admissions",
        F.try_divide("_dose_sum", "_doses").alias("mean_dose"),
        F.try_divide("_inside", "_settings").alias("share_inside"),
    )


def exposures_with_units(df: DataFrame, k: int, cols: ExposureColumns = DRUGS) -> DataFrame:
    """The top ``k`` names with their dominant unit.

    ``mean_dose`` is over all units; ``mean_dose_dominant_unit`` only over exposures
    in the dominant unit. The totals are brought to one row per name by aggregation
    rather than a self-join, which would read the exposures twice.
    """
    of_name, of_unit = F.col("per_unit") == 0, F.col("per_unit") == 1
    unit, n = F.col(cols.unit), F.col("n_prescriptions")
    # most frequent first, equal counts by unit, a missing unit last
    order = F.when(of_unit, F.struct(-n, unit.isNull(), unit))
    dominant = F.min_by(F.struct(unit.alias("unit"), F.col("mean_dose").alias("mean")), order)
    own = lambda c: F.max(F.when(of_name, F.col(c))).alias(c)
    totals = ["n_prescriptions", "n_admissions", "mean_dose", "share_inside"]
    per_name = unit_totals(df, cols).groupBy(cols.name).agg(*map(own, totals), dominant.alias("_top"))
    return per_name.orderBy(*_by_count(cols.name)).limit(k).select(
        cols.name,
        "n_prescriptions",
        "n_admissions",
        F.round("mean_dose", 2).alias("mean_dose"),
        F.round("_top.mean", 2).alias("mean_dose_dominant_unit"),
        F.round(100 * F.col("share_inside"), 1).alias("pct_in_icu"),
        F.round(F.try_divide(n, F.col("n_admissions")), 2).alias("per_admission"),
        F.col("_top.unit").alias("dominant_unit"),
    )


def _top_doses(df: DataFrame, k: int, cols: ExposureColumns = DRUGS) -> DataFrame:
    """``drug, unit, value, n``: dose counts of the ``k`` most frequent names.

    Names are ranked on the counts, so the exposures themselves are read once. The
    counts of missing doses stay in, because dropping them in one user of the counts
    and not in the other would keep Spark from sharing the work.
    """
    counts = df.groupBy(cols.name, cols.unit, number_from_text(cols.dose).alias("value")).agg(F.count("*").alias("n"))
    top = counts.groupBy(cols.name).agg(F.sum("n").alias("n_prescriptions")).orderBy(*_by_count(cols.name)).limit(k)
    counts, top = counts.alias("c"), top.alias("t")
    same_name = F.col(f"c.{cols.name}").eqNullSafe(F.col(f"t.{cols.name}"))
    return counts.join(top, same_name, "left_semi").select(cols.name, cols.unit, "value", "n")


def _weighted(value: Column) -> tuple[Column, Column]:
    """Number and mean of the known values, given how often each occurs."""
    known = F.sum(F.when(value.isNotNull(), F.col("n")))
    return known, F.sum(value * F.col("n")) / known


def dose_by_unit(df: DataFrame, k: int, cols: ExposureColumns = DRUGS) -> DataFrame:
    """Number, mean and median of the known doses per name and unit, top ``k`` names.

    Doses are counted when this is called.
    """
    keys = [cols.name, cols.unit]
    doses = scratch(_top_doses(df, k, cols), "doses")
    known, mean = _weighted(F.col("value"))
    means = doses.groupBy(*keys).agg(known.alias("n"), mean.alias("mean_dose"))
    medians = written_quantiles(doses, keys, {"median_dose": 0.5})
    merged = [F.max("n").alias("n")]
    merged += [F.round(F.max(c), 2).alias(c) for c in ("mean_dose", "median_dose")]
    both = means.unionByName(medians, True).groupBy(*keys).agg(*merged)
    return both.where(F.col("n").isNotNull()).orderBy(*_name_then_count(cols))


def _name_then_count(cols: ExposureColumns) -> list[Column]:
    return [F.col(cols.name).asc_nulls_last(), F.desc("n"), F.col(cols.unit).asc_nulls_last()]


def dose_units_used(df: DataFrame, k: int, cols: ExposureColumns = DRUGS) -> DataFrame:
    """All exposures per name and unit, with their mean dose, top ``k`` names.

    Rows without a dose count too, but a name with no dose at all is left out.
    """
    _, mean = _weighted(F.col("value"))
    per_unit = _top_doses(df, k, cols).groupBy(cols.name, cols.unit).agg(
        F.sum("n").alias("n"), F.round(mean, 2).alias("mean_dose")
    )
    with_any = F.max("mean_dose").over(Window.partitionBy(cols.name))
    kept = per_unit.withColumn("_any", with_any).where(F.col("_any").isNotNull()).drop("_any")
    return kept.orderBy(*_name_then_count(cols))


def setting_split(df: DataFrame, k: int, cols: ExposureColumns = DRUGS) -> DataFrame:
    """Exposures inside and outside per name, top ``k`` names, with the share inside."""
    split = df.groupBy(cols.name).pivot(cols.inside, [0, 1]).agg(F.count(F.lit(1))).na.fill(0, ["0", "1"])
    renamed = split.withColumnsRenamed({"0": "not_in_icu", "1": "in_icu"})
    both = F.col("in_icu") + F.col("not_in_icu")
    top = renamed.withColumn("n_prescriptions", both).orderBy(*_by_count(cols.name)).limit(k)
    share = percent(F.col("in_icu"), F.col("n_prescriptions"))
    return top.select(cols.name, "in_icu", "not_in_icu", share.alias("in_icu_pct")).orderBy(
        F.col(cols.name).asc_nulls_last()
    )
