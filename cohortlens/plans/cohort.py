"""One row per admission: flags, demographics and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, CohortConfig
from ..functions import (
    bin_numeric,
    bucket_text,
    code_labels,
    elapsed_days,
    full_years,
    keep_levels,
)
from ..operators.flags import flag_by_codes, left_flags
from ..operators.intervals import total_interval_days
from ..schemas import ClinicalTables


def build_cohort(tables: ClinicalTables, config: CohortConfig = DEFAULT) -> DataFrame:
    """All admissions of known patients.

    Patients are joined first, so that the result and everything joined after it
    are partitioned by ``hadm_id`` and share one shuffle.
    """
    flags = flag_by_codes(tables.diagnoses_icd, "hadm_id", config.rules)
    stays = total_interval_days(tables.icustays, "hadm_id", "intime", "outtime", "icu_los_days")
    admitted = tables.admissions.join(tables.patients, "subject_id").select(
        "subject_id",
        "hadm_id",
        "gender",
        full_years("dob", "admittime", config.age_cap).alias("age"),
        bucket_text("ethnicity", config.ethnicity_patterns, config.ethnicity_default).alias(
            "ethnicity_group"
        ),
        "admission_type",
        elapsed_days("admittime", "dischtime").alias("hospital_los_days"),
        "hospital_expire_flag",
    )
    cohort = left_flags(admitted, flags, "hadm_id").join(stays, "hadm_id", "left")
    return cohort.select(
        "subject_id",
        "hadm_id",
        *config.rules,
        "gender",
        "age",
        "ethnicity_group",
        "admission_type",
        "hospital_los_days",
        "icu_los_days",
        "hospital_expire_flag",
    )


def label_cohort(cohort: DataFrame, config: CohortConfig = DEFAULT) -> DataFrame:
    """Add ``age_group`` and ``diabetes_status``; off-level genders become NULL."""
    return cohort.withColumns(
        {
            "age_group": bin_numeric("age", config.age_cuts, config.age_groups, config.null_age),
            "diabetes_status": code_labels(config.status_flag, config.status_labels),
            "gender": keep_levels("gender", config.genders),
        }
    )


def split_cohort(cohort: DataFrame, config: CohortConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Cases and the others."""
    flag = F.col(config.case_flag)
    return cohort.where(flag == 1), cohort.where(flag == 0)
