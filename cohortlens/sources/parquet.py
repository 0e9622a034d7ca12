"""Parquet folders, one per table."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schemas import SCHEMAS, ClinicalTables


def load_tables(spark: SparkSession, folder: str, suffix: str = "") -> ClinicalTables:
    """Read ``folder/<table><suffix>`` for the five tables and check their schemas.

    The schema comes from the files, so that a wrong type is reported by name
    instead of failing in a task; narrower types are widened where that loses nothing,
    and only declared columns are read.
    """
    root = folder.rstrip("/")
    return ClinicalTables(**{t: spark.read.parquet(f"{root}/{t}{suffix}") for t in SCHEMAS})
