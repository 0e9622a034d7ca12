"""One row per prescription of a case admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, CohortConfig
from ..operators.intervals import flag_in_interval
from ..schemas import ClinicalTables


def build_exposures(
    tables: ClinicalTables, cohort: DataFrame, config: CohortConfig = DEFAULT
) -> DataFrame:
    """Prescriptions of cases with a 0/1 flag: started during an ICU stay?

    ``startdate`` is kept, so that missing start dates can be counted.
    """
    given = tables.prescriptions.select("hadm_id", "drug", "dose_val_rx", "dose_unit_rx", "startdate")
    cases = cohort.where(F.col(config.case_flag) == 1).select("hadm_id")
    stay = ("hadm_id", "startdate", "intime", "outtime")
    return flag_in_interval(given, tables.icustays, *stay, "in_icu", only=cases)
