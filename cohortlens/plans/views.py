"""The study under names that SQL can use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, CohortConfig
from ..schemas import ClinicalTables
from .cohort import build_cohort
from .exposures import build_exposures


def create_views(
    tables: ClinicalTables,
    config: CohortConfig = DEFAULT,
    cohort_view: str = "cohort",
    exposures_view: str = "exposures",
    case_view: str = "cases",
) -> tuple[DataFrame, DataFrame]:
    """Register (or replace) cohort, exposures and, in SQL over the first, the cases.

    Nothing is computed until a view is read.
    """
    cohort = build_cohort(tables, config)
    exposures = build_exposures(tables, cohort, config)
    cohort.createOrReplaceTempView(cohort_view)
    exposures.createOrReplaceTempView(exposures_view)
    cohort.sparkSession.sql(
        f"CREATE OR REPLACE TEMPORARY VIEW {case_view} AS SELECT * FROM {cohort_view} WHERE {config.case_flag} = 1"
    )
    return cohort, exposures


#: Checks over the views, one row each; the names of the views go into the braces.
CHECKS = """
WITH of_cohort AS (
  SELECT count(*) AS n, count_if({flag} = 1) AS n_cases,
    min(hospital_los_days) AS shortest, max(hospital_los_days) AS longest,
    round(avg(hospital_los_days), 1) AS mean_los, count_if(hospital_los_days < 0) AS negative,
    count_if(icu_los_days > 0) AS with_icu,
    count_if(icu_los_days IS NULL OR icu_los_days = 0) AS without_icu
  FROM {cohort}
),
of_cases AS (SELECT count(*) AS n, count(DISTINCT subject_id) AS patients FROM {cases}),
of_exposures AS (
  SELECT count(*) AS n, count(DISTINCT hadm_id) AS admissions, count(DISTINCT drug) AS drugs
  FROM {exposures}
)
SELECT stack(9,
    'total_admissions', double(n), 'case_admissions', double(n_cases),
    'case_pct', round(100 * try_divide(double(n_cases), n), 1),
    'min_los', round(shortest, 6), 'max_los', round(longest, 6), 'mean_los', mean_los,
    'negative_los', double(negative), 'with_icu', double(with_icu), 'without_icu', double(without_icu)
  ) AS (check_name, value)
FROM of_cohort
UNION ALL
SELECT stack(2, 'cases_view', double(n), 'case_patients', double(patients)) AS (check_name, value) FROM of_cases
UNION ALL
SELECT stack(3,
    'prescriptions', double(n), 'prescribed_admissions', double(admissions), 'unique_drugs', double(drugs)
  ) AS (check_name, value)
FROM of_exposures
"""


def view_checks(
    spark: SparkSession,
    cohort_view: str = "cohort",
    exposures_view: str = "exposures",
    case_view: str = "cases",
    config: CohortConfig = DEFAULT,
) -> DataFrame:
    """Sanity checks in SQL over registered views: ``check_name, value``."""
    names = {"cohort": cohort_view, "exposures": exposures_view, "cases": case_view}
    return spark.sql(CHECKS.format(**names, flag=config.case_flag))
