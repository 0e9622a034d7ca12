"""Cohort analytics on Spark DataFrames."""

from .config import DEFAULT, CodeRule, CohortConfig
from .schemas import SCHEMAS, ClinicalTables, SchemaError

__all__ = ["DEFAULT", "SCHEMAS", "ClinicalTables", "CodeRule", "CohortConfig", "SchemaError"]
