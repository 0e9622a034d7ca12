"""Input tables of a cohort study and the check that a frame fits them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ByteType,
    CharType,
    DataType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    VarcharType,
)

LONG, INT, TEXT, TIME = LongType(), IntegerType(), StringType(), TimestampNTZType()


def _schema(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


SCHEMAS: dict[str, StructType] = {
    "patients": _schema(subject_id=LONG, gender=TEXT, dob=TIME),
    "admissions": _schema(
        subject_id=LONG,
        hadm_id=LONG,
        admittime=TIME,
        dischtime=TIME,
        ethnicity=TEXT,
        admission_type=TEXT,
        hospital_expire_flag=INT,
    ),
    "diagnoses_icd": _schema(hadm_id=LONG, seq_num=INT, icd9_code=TEXT),
    "icustays": _schema(hadm_id=LONG, intime=TIME, outtime=TIME),
    "prescriptions": _schema(
        hadm_id=LONG, drug=TEXT, dose_val_rx=TEXT, dose_unit_rx=TEXT, startdate=TIME
    ),
}


class SchemaError(ValueError):
    """A table lacks a column or holds it with another type."""


#: Types that a declared type takes in without losing anything.
WIDENED: dict[DataType, tuple[type[DataType], ...]] = {
    LONG: (ByteType, ShortType, IntegerType),
    INT: (ByteType, ShortType),
    TEXT: (CharType, VarcharType),
    TIME: (DateType,),
}


def _widened(name: str, wanted: DataType, found: DataType) -> Column | None:
    """The column as declared, or None where a cast could lose or change a value."""
    if found == wanted:
        return F.col(name)
    whole = isinstance(found, DecimalType) and found.scale == 0
    digits = {LONG: 18, INT: 9}.get(wanted, 0)
    if isinstance(found, WIDENED[wanted]) or (whole and found.precision <= digits):
        return F.col(name).cast(wanted).alias(name)
    return None


def conform(df: DataFrame, name: str) -> DataFrame:
    """Check names and types of table ``name`` and keep only its declared columns.

    Narrower types are widened where that is lossless: smaller integers, decimals without
    places, dates (midnight), character types of bounded length. A time with a zone is
    not taken for one without, because its clock time would depend on the session.
    """
    found = {f.name: f.dataType for f in df.schema.fields}
    problems, columns = [], []
    for wanted in SCHEMAS[name].fields:
        if wanted.name not in found:
            problems.append(f"{wanted.name} is missing")
            continue
        column = _widened(wanted.name, wanted.dataType, found[wanted.name])
        if column is None:
            have = found[wanted.name].simpleString()
            problems.append(f"{wanted.name} is {have}, not {wanted.dataType.simpleString()}")
        columns.append(column)
    if problems:
        raise SchemaError(f"table {name}: " + "; ".join(problems))
    return df.select(*columns)


@dataclass(frozen=True)
class ClinicalTables:
    """The five lazy input frames, passed along instead of globals."""

    patients: DataFrame
    admissions: DataFrame
    diagnoses_icd: DataFrame
    icustays: DataFrame
    prescriptions: DataFrame

    def __post_init__(self) -> None:
        for name in SCHEMAS:
            object.__setattr__(self, name, conform(getattr(self, name), name))

    def create_views(self, prefix: str = "") -> None:
        """Register (or replace) a temporary view per table."""
        for name in SCHEMAS:
            getattr(self, name).createOrReplaceTempView(prefix + name)
