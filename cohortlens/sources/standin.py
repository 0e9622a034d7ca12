"""Five clinical-shaped tables derived from the order tables of the test data.

The real source is access-restricted. Every column is a fixed expression of the
given rows, so row counts and skew follow the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import ClinicalTables

# The texts that the stand-in columns take, by remainder.
ETHNICITIES = {
    0: "WHITE",
    1: "WHITE - RUSSIAN",
    2: "White",
    3: "BLACK/AFRICAN AMERICAN",
    4: "ASIAN - CHINESE",
    5: "HISPANIC OR LATINO",
    6: "BLACK/HISPANIC",
    7: "CAUCASIAN",
}
CODES = {0: "4280", 1: "42832", 2: "24900", 3: "25000", 4: "25060", 5: None, 6: "41401"}
OTHER_CODE = "4019"
UNITS = {0: "mL", 1: "UNIT", 2: None}
OTHER_UNIT = "mg"

# The columns in use, declared so that no file is opened before the query runs.
GIVEN = {
    "customer": "c_custkey bigint",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz,"
        " o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_returnflag string"
    ),
    "part": "p_partkey bigint, p_name string",
}


def _by_remainder(number: Column, texts: dict[int, str | None], other: str | None) -> Column:
    chain = F
    for remainder, text in texts.items():
        chain = chain.when(number == remainder, F.lit(text))
    return chain.otherwise(F.lit(other))


def _plus(at: Column, unit: str, amount: Column) -> Column:
    """Add hours or days to a zone-less time."""
    return at + F.make_dt_interval(**{unit: amount.cast("int")})


def standin_tables(spark: SparkSession, folder: str) -> ClinicalTables:
    root = folder.rstrip("/")
    customer, orders, lineitem, part = (
        spark.read.schema(columns).parquet(f"{root}/{name}.parquet") for name, columns in GIVEN.items()
    )
    return ClinicalTables(
        patients=_patients(customer),
        admissions=_admissions(orders),
        diagnoses_icd=_diagnoses(lineitem),
        icustays=_stays(lineitem, orders),
        prescriptions=_prescriptions(lineitem, orders, part),
    )


def _patients(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    first_day = F.lit("1895-01-01 00:00:00").cast("timestamp_ntz")
    return customer.select(
        key.alias("subject_id"),
        F.when(key % 20 < 9, "F").when(key % 20 < 19, "M").otherwise("U").alias("gender"),
        F.when(key % 97 != 0, _plus(first_day, "days", key * 7919 % 36500)).alias("dob"),
    )


def _admissions(orders: DataFrame) -> DataFrame:
    key, admitted = F.col("o_orderkey"), F.col("o_orderdate")
    return orders.select(
        F.col("o_custkey").alias("subject_id"),
        key.alias("hadm_id"),
        admitted.alias("admittime"),
        _plus(admitted, "hours", key * 7919 % 720 - 12).alias("dischtime"),
        _by_remainder(key % 9, ETHNICITIES, None).alias("ethnicity"),
        F.col("o_orderpriority").alias("admission_type"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("hospital_expire_flag"),
    )


def _diagnoses(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("hadm_id"),
        F.col("l_linenumber").alias("seq_num"),
        _by_remainder(F.col("l_partkey") % 16, CODES, OTHER_CODE).alias("icd9_code"),
    )


def _stays(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    supplier, admitted = F.col("l_suppkey"), F.col("o_orderdate")
    stays = lineitem.where(F.col("l_returnflag") == "R")
    leave = _plus(admitted, "hours", supplier % 48 + F.col("l_partkey") % 120 - 6)
    return stays.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("hadm_id"),
        _plus(admitted, "hours", supplier % 48).alias("intime"),
        F.when(supplier % 50 != 0, leave).alias("outtime"),
    )


def _prescriptions(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    supplier, item = F.col("l_suppkey"), F.col("l_partkey")
    dose = F.when(item % 23 == 0, F.lit("1-2")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    started = _plus(F.col("o_orderdate"), "days", F.col("l_linenumber") - 1)
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, item == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("hadm_id"),
            F.col("p_name").alias("drug"),
            F.when(supplier % 29 != 0, dose).alias("dose_val_rx"),
            _by_remainder(item % 5, UNITS, OTHER_UNIT).alias("dose_unit_rx"),
            F.when(supplier % 31 != 0, started).alias("startdate"),
        )
    )
