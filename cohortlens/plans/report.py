"""The four report tables, numeric first, and their text form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import DEFAULT, CohortConfig
from ..functions import count_percent, fixed_point, level_rank, median_iqr_text, title_case
from ..operators.crosstab import crosstab
from ..operators.exposures import ExposureColumns, exposures_with_units
from ..operators.strata import outcomes_by
from ..schemas import ClinicalTables
from ..sources.snapshot import freeze, thaw
from .cohort import build_cohort, label_cohort, split_cohort
from .exposures import build_exposures
from .titles import titled

# Row and column titles of the printed tables.
VARIABLE_LABELS = {
    "age_group": "Age group",
    "gender": "Gender",
    "ethnicity_group": "Ethnicity",
    "admission_type": "Admission type",
}
STRATA = {
    "Age": "age_group",
    "Gender": "gender",
    "Diabetes status": "diabetes_status",
    "Ethnicity": "ethnicity_group",
}
OUTCOME_LABELS = {
    "stratum": "Group",
    "hospital_los": "Hospital LOS, days (median [IQR])",
    "icu_los": "ICU LOS, days (median [IQR])",
    "mortality": "In-hospital mortality (%)",
}
EXPOSURE_LABELS = {
    "drug": "Medication",
    "n_prescriptions": "Total prescriptions, n",
    "mean_dose": "Mean dose",
    "pct_in_icu": "% prescribed in ICU",
    "per_admission": "Mean prescriptions per admission",
    "dominant_unit": "Dose unit",
}
DEMOGRAPHIC_LABELS = {"variable": "Characteristic", "level": "Level"}
TABLE_TITLES = {
    "demographics_cases": "Table 1. Demographic characteristics of heart failure admissions by diabetes status",
    "demographics_controls": "Table 2. Demographic characteristics of non-heart failure admissions by diabetes status",
    "outcomes": "Table 3. Clinical outcomes of heart failure admissions by patient characteristics",
    "exposures": "Table 4. Most commonly prescribed medications in heart failure admissions",
}
DOSE_NOTE = "*Dose summaries were calculated using the most frequently recorded dose unit per medication.*"
MEASURES = ("hospital_los_days", "icu_los_days")
MEASURE_NAMES = {"hospital_los_days": "hospital_los", "icu_los_days": "icu_los"}
DEATH = "hospital_expire_flag"


@dataclass(frozen=True)
class ReportConfig:
    """What the four tables are about. The default is the heart-failure report."""

    #: variables of the demographics tables and their titles, in printed order
    variables: Mapping[str, str] = field(default_factory=lambda: dict(VARIABLE_LABELS))
    #: the column variable of those tables; its levels are the status labels of the study
    status: str = "diabetes_status"
    #: stratifications of the outcomes table: title and column, in printed order
    strata: Mapping[str, str] = field(default_factory=lambda: dict(STRATA))
    #: measures of the outcomes table and the names of their printed columns
    measures: Mapping[str, str] = field(default_factory=lambda: dict(MEASURE_NAMES))
    #: 0/1 column whose rate is the last one of the outcomes table
    flag: str = DEATH
    outcome_labels: Mapping[str, str] = field(default_factory=lambda: dict(OUTCOME_LABELS))
    exposure_columns: ExposureColumns = ExposureColumns()
    exposure_labels: Mapping[str, str] = field(default_factory=lambda: dict(EXPOSURE_LABELS))
    titles: Mapping[str, str] = field(default_factory=lambda: dict(TABLE_TITLES))
    dose_note: str | None = DOSE_NOTE


REPORT = ReportConfig()
# Column suffixes of the first two status groups; further ones are numbered.
STATUS_SUFFIXES = ("without", "with")


def status_suffixes(config: CohortConfig) -> dict[str, str]:
    """Column suffix of every status label."""
    labels = list(config.status_labels.values())
    numbered = (f"s{i}" for i in range(len(STATUS_SUFFIXES), len(labels)))
    return dict(zip(labels, [*STATUS_SUFFIXES[: len(labels)], *numbered], strict=True))


def demographics(
    labeled: DataFrame, config: CohortConfig = DEFAULT, report: ReportConfig = REPORT
) -> DataFrame:
    """The report's variables by comorbidity status."""
    known = {"age_group": config.age_groups, "gender": config.genders}
    levels = {name: known[name] for name in report.variables if name in known}
    return crosstab(labeled, list(report.variables), report.status, status_suffixes(config), levels)


def outcomes(labeled: DataFrame, report: ReportConfig = REPORT) -> DataFrame:
    """The report's measures and the rate of its flag over its stratifications."""
    return outcomes_by(labeled, report.strata, list(report.measures), report.flag)


def top_exposures_report(exposures: DataFrame, k: int = 5, report: ReportConfig = REPORT) -> DataFrame:
    """The ``k`` most frequent exposures in printed spelling."""
    cols = report.exposure_columns
    return exposures_with_units(exposures, k, cols).withColumns(
        {cols.name: title_case(cols.name), "dominant_unit": F.upper("dominant_unit")}
    )


def report_tables(
    labeled: DataFrame,
    exposures: DataFrame,
    config: CohortConfig = DEFAULT,
    k: int = 5,
    report: ReportConfig = REPORT,
) -> dict[str, DataFrame]:
    """All four tables from a labelled cohort and its exposures."""
    cases, others = split_cohort(labeled, config)
    return {
        "demographics_cases": demographics(cases, config, report),
        "demographics_controls": demographics(others, config, report),
        "outcomes": outcomes(cases, report),
        "exposures": top_exposures_report(exposures, k, report),
    }


def freeze_report(
    spark: SparkSession,
    tables: ClinicalTables,
    folder: str,
    config: CohortConfig = DEFAULT,
    k: int = 5,
    report: ReportConfig = REPORT,
) -> dict[str, DataFrame]:
    """Write cohort, exposures and the four tables below ``folder``; return them read back.

    The cohort and the exposures are written first and the tables read those files,
    so the source is read once and a lost executor repeats only its own task.
    """
    root = folder.rstrip("/")
    keep = lambda df, name: thaw(spark, freeze(df, f"{root}/{name}"))
    cohort = keep(label_cohort(build_cohort(tables, config), config), "cohort_rows")
    exposures = keep(build_exposures(tables, cohort, config), "exposure_rows")
    frozen = {"cohort_rows": cohort, "exposure_rows": exposures}
    for name, table in report_tables(cohort, exposures, config, k, report).items():
        frozen[name] = keep(table, name)
    return frozen


def _in_order(df: DataFrame, block: Column, order: Sequence[Column], columns: Sequence[Column]) -> DataFrame:
    """The columns behind ``block`` (order of the blocks) and ``position`` (within it), sorted by both.

    A block is numbered by one task, so this is for tables that are printed.
    """
    place = F.row_number().over(Window.partitionBy(block).orderBy(*order))
    return df.select(block.alias("block"), place.alias("position"), *columns).orderBy("block", "position")


def present_demographics(
    table: DataFrame,
    config: CohortConfig = DEFAULT,
    title: str | None = None,
    report: ReportConfig = REPORT,
) -> DataFrame:
    """``n (p%)`` per status group, rows in printed order, group sizes in the titles."""
    order = [F.col("position").asc_nulls_last(), F.col("level").asc_nulls_last()]
    name = F.col("variable")
    for variable, label in report.variables.items():
        name = F.when(F.col("variable") == variable, F.lit(label)).otherwise(name)
    columns = [name.alias("variable"), F.col("level")]
    labels = dict(DEMOGRAPHIC_LABELS)
    for label, suffix in status_suffixes(config).items():
        columns.append(count_percent(f"n_{suffix}", f"pct_{suffix}").alias(suffix))
        size = F.concat(F.lit(f"**{label}** (N="), F.col(f"total_{suffix}").cast("string"), F.lit(")"))
        columns.append(size.alias(f"{suffix}_title"))
        labels[suffix] = f"**{label}**"
    block = F.coalesce(level_rank("variable", list(report.variables)), F.lit(len(report.variables) + 1))
    return titled(_in_order(table, block, ["variable", *order], columns), labels, title)


def present_outcomes(
    table: DataFrame, config: CohortConfig = DEFAULT, report: ReportConfig = REPORT
) -> DataFrame:
    """``median (q25–q75)`` per stratum, strata in printed order."""
    levels = [*config.age_groups, *config.genders, *config.status_labels.values()]
    order = ["stratifier", level_rank("stratum", levels).asc_nulls_last(), F.col("stratum").asc_nulls_last()]
    spread = lambda m: median_iqr_text(f"{m}_q25", f"{m}_median", f"{m}_q75")
    columns = [
        F.col("stratifier"),
        F.col("stratum"),
        *[spread(measure).alias(name) for measure, name in report.measures.items()],
        fixed_point(f"{report.flag}_pct").alias("mortality"),
    ]
    block = F.coalesce(level_rank("stratifier", list(report.strata)), F.lit(len(report.strata) + 1))
    return titled(_in_order(table, block, order, columns), report.outcome_labels, report.titles.get("outcomes"))


def present_exposures(table: DataFrame, report: ReportConfig = REPORT) -> DataFrame:
    """The printed columns, most prescribed first."""
    labels = report.exposure_labels
    order = [F.desc("n_prescriptions"), F.col(report.exposure_columns.name).asc_nulls_last()]
    shown = _in_order(table, F.lit(1), order, [F.col(c) for c in labels])
    return titled(shown.drop("block"), labels, report.titles.get("exposures"), report.dose_note)


def present_report(
    frozen: Mapping[str, DataFrame], config: CohortConfig = DEFAULT, report: ReportConfig = REPORT
) -> dict[str, DataFrame]:
    """The four tables of :func:`report_tables` or :func:`freeze_report` as they are printed."""
    shown = {
        name: present_demographics(frozen[name], config, report.titles.get(name), report)
        for name in ("demographics_cases", "demographics_controls")
    }
    shown["outcomes"] = present_outcomes(frozen["outcomes"], config, report)
    shown["exposures"] = present_exposures(frozen["exposures"], report)
    return shown
