"""Named queries over the stand-in tables, one per operator or report table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import operators as op
from . import plans
from .config import DEFAULT
from .functions import number_from_text
from .plans.report import DEATH, MEASURES
from .sources import freeze, snapshot_folder, standin_tables, thaw

LOS, ICU_LOS = MEASURES


class Study:
    """The lazy frames that the queries share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.tables = standin_tables(spark, folder)

    @cached_property
    def cohort(self) -> DataFrame:
        return plans.build_cohort(self.tables)

    @cached_property
    def labeled(self) -> DataFrame:
        return plans.label_cohort(self.cohort)

    @cached_property
    def cases(self) -> DataFrame:
        return plans.split_cohort(self.labeled)[0]

    @cached_property
    def controls(self) -> DataFrame:
        return plans.split_cohort(self.labeled)[1]

    @cached_property
    def exposures(self) -> DataFrame:
        return plans.build_exposures(self.tables, self.cohort)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns, so that the last bits of two engines compare equal."""
    return df.select(
        *[F.round(name, digits).alias(name) if kind == "double" else F.col(name) for name, kind in df.dtypes]
    )


def _case_split(s: Study) -> DataFrame:
    name = F.when(F.col("heart_failure") == 1, "Heart Failure").otherwise("Non-HF")
    return op.frequency(s.cohort, "heart_failure").withColumn("cohort", name)


def _freq_setting(s: Study) -> DataFrame:
    name = F.when(F.col("in_icu") == 1, "In ICU").otherwise("Not in ICU")
    return op.frequency(s.exposures, "in_icu").select(name.alias("location"), "n", "pct")


def _missing_exposures(s: Study) -> DataFrame:
    parsed = s.exposures.withColumn("dose_value", number_from_text("dose_val_rx"))
    checked = ["dose_val_rx", "dose_value", "dose_unit_rx", "startdate"]
    return op.missing_profile(parsed, checked, only_missing=False)


def _outcomes_by_age(s: Study) -> DataFrame:
    table = op.outcomes_by(s.cases, {"Age": "age_group"}, MEASURES, DEATH, keep_null=True)
    return table.select(
        F.col("stratum").alias("age_group"),
        "n",
        F.round(f"{LOS}_median", 1).alias("median_los"),
        F.round(f"{ICU_LOS}_median", 1).alias("median_icu"),
        F.col(f"{DEATH}_pct").alias("mortality_pct"),
    )


def _frozen_outcomes(s: Study) -> DataFrame:
    """Freeze the outcome table in a new folder and read it back."""
    path = snapshot_folder(s.spark, "outcomes")
    return thaw(s.spark, freeze(rounded(plans.outcomes(s.cases)), path))


def _view_checks(s: Study) -> DataFrame:
    """Checks by SQL over the views, under names of their own."""
    names = {f"{view}_view": f"study_{view}" for view in ("cohort", "exposures", "case")}
    plans.create_views(s.tables, **names)
    return plans.view_checks(s.spark, **names)


QUERIES: dict[str, Callable[[Study], DataFrame]] = {
    # building blocks
    "code_flags": lambda s: op.flag_by_codes(s.tables.diagnoses_icd, "hadm_id", DEFAULT.rules),
    "interval_totals": lambda s: op.total_interval_days(
        s.tables.icustays, "hadm_id", "intime", "outtime", "icu_los_days"
    ),
    "cohort": lambda s: s.cohort,
    "cohort_labeled": lambda s: s.labeled,
    "exposures": lambda s: s.exposures,
    # distributions
    "cohort_size": lambda s: s.cohort.agg(F.count("*").alias("total_admissions")),
    "case_split": _case_split,
    "freq_age": lambda s: op.frequency(s.cases, "age_group", DEFAULT.age_groups),
    "freq_gender": lambda s: op.frequency(s.cases, "gender", DEFAULT.genders),
    "freq_ethnicity": lambda s: op.frequency(s.cases, "ethnicity_group", by_count=True),
    "freq_admission": lambda s: op.frequency(s.cases, "admission_type", by_count=True),
    "freq_status": lambda s: op.frequency(
        s.cases, "diabetes_status", list(DEFAULT.status_labels.values())
    ),
    "freq_setting": _freq_setting,
    # profiles and checks
    "los_profile": lambda s: rounded(op.numeric_profile(s.cases, LOS)),
    "los_profile_all": lambda s: rounded(op.numeric_profile(s.labeled, LOS)),
    "icu_profile": lambda s: rounded(op.numeric_profile(s.cases, ICU_LOS)),
    "missing_cohort": lambda s: op.missing_profile(s.labeled),
    "missing_exposures": _missing_exposures,
    "mortality": lambda s: op.event_rate(s.cases, DEATH),
    "mortality_all": lambda s: op.event_rate(s.labeled, DEATH),
    "los_checks": lambda s: rounded(op.duration_checks(s.cohort, LOS)),
    "icu_checks": lambda s: op.presence_checks(s.cohort, ICU_LOS),
    "age_checks": lambda s: op.cap_checks(s.cases, "age", DEFAULT.age_cap),
    "range_checks": lambda s: rounded(op.range_checks(s.cases, MEASURES, "age", DEFAULT.age_cap)),
    "exposure_overview": lambda s: op.exposure_overview(s.exposures),
    # report tables
    "demographics_cases": lambda s: plans.demographics(s.cases),
    "demographics_controls": lambda s: plans.demographics(s.controls),
    "outcomes_stratified": lambda s: rounded(plans.outcomes(s.cases)),
    "outcomes_by_age": _outcomes_by_age,
    "frozen_outcomes": _frozen_outcomes,
    "top_exposures_report": lambda s: plans.top_exposures_report(s.exposures, 5),
    # report tables as they are printed
    "present_demographics_cases": lambda s: plans.present_demographics(plans.demographics(s.cases)),
    "present_demographics_controls": lambda s: plans.present_demographics(plans.demographics(s.controls)),
    "present_outcomes": lambda s: plans.present_outcomes(plans.outcomes(s.cases)),
    "present_exposures": lambda s: plans.present_exposures(plans.top_exposures_report(s.exposures, 5)),
    "view_checks": _view_checks,
    # exposures
    "top_exposures": lambda s: op.top_exposures(s.exposures, 10),
    "dominant_unit": lambda s: op.dominant_value(s.exposures, "drug", "dose_unit_rx"),
    "exposure_detail": lambda s: op.exposure_detail(s.exposures, 5),
    "dose_by_unit": lambda s: op.dose_by_unit(s.exposures, 5),
    "dose_units_used": lambda s: op.dose_units_used(s.exposures, 5),
    "setting_split": lambda s: op.setting_split(s.exposures, 5),
}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](Study(spark, folder))
