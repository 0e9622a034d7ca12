"""Relational source. Credentials come from the caller and are never stored here."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from ..schemas import SCHEMAS, ClinicalTables

PARTITION_COLUMNS = {name: "hadm_id" for name in SCHEMAS} | {"patients": "subject_id"}
#: Name that the table has inside a predicate.
ROW = "source_row"
# SQL that hashes a whole row to a number, by the kind of database in the url.
ROW_HASHES = {
    "postgresql": f"hashtextextended({ROW}::text, 0)",
}


def row_hash_of(connection: Mapping[str, str]) -> str | None:
    """Hash expression of the database that the url names, if one is known."""
    kind = connection.get("url", "").split(":")[1:2]
    return ROW_HASHES.get(kind[0]) if kind else None


def jdbc_predicates(partitions: int, row_hash: str) -> list[str]:
    """One condition per task; together they hold every row exactly once.

    The hash is of the whole row, so a key that a third of all rows share is spread, and
    neither bounds nor a partition column need to be known. A NULL hash goes to the first.
    """
    if partitions < 1:
        raise ValueError("partitions must be at least 1")
    place = f"mod(abs(mod({row_hash}, {partitions})), {partitions})"
    return [f"coalesce({place}, 0) = {i}" for i in range(partitions)]


def jdbc_options(
    name: str,
    connection: Mapping[str, str],
    bounds: Mapping[str, tuple[int, int]] | None = None,
    partitions: int = 64,
    fetch_size: int = 10_000,
    db_schema: str | None = None,
    aliased: bool = False,
) -> dict[str, str]:
    """Reader options for one table.

    ``connection`` holds url, user, password, driver. ``bounds`` gives the lowest
    and highest key per partition column; with it the read is split into
    ``partitions`` range queries. ``aliased`` names the row for predicates.
    """
    if "url" not in connection:
        raise ValueError("connection needs a url")
    options = dict(connection)
    options["dbtable"] = f"{db_schema}.{name}" if db_schema else name
    if aliased:
        options["dbtable"] += f" {ROW}"
    options["fetchsize"] = str(fetch_size)
    options["preferTimestampNTZ"] = "true"
    key = PARTITION_COLUMNS[name]
    if bounds and key in bounds:
        low, high = bounds[key]
        options |= {
            "partitionColumn": key,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(partitions),
        }
    return options


def adapt_columns(df: DataFrame, name: str) -> DataFrame:
    """Cast database types (int4, date, ...) to the declared ones; text stays text."""
    columns = []
    for wanted in SCHEMAS[name].fields:
        col = F.col(wanted.name)
        if isinstance(wanted.dataType, StringType):
            col = col.cast("string")
        columns.append(col.cast(wanted.dataType).alias(wanted.name))
    return df.select(*columns)


def read_plan(
    name: str,
    connection: Mapping[str, str],
    bounds: Mapping[str, tuple[int, int]] | None = None,
    partitions: int = 64,
    row_hash: str | None = None,
    **kwargs,
) -> tuple[dict[str, str], list[str] | None]:
    """Options and predicates with which a table is read.

    Bounds of its key split it into ranges; else a hash of the row does, given or known
    for the database. A read by one task has to be asked for with ``partitions=1``.
    """
    row_hash = row_hash or row_hash_of(connection)
    if bounds and PARTITION_COLUMNS[name] in bounds:
        return jdbc_options(name, connection, bounds, partitions, **kwargs), None
    if partitions == 1:
        return jdbc_options(name, connection, **kwargs), None
    if row_hash is None:
        raise ValueError(f"{name} would be read by one task: give bounds, row_hash or partitions=1")
    return jdbc_options(name, connection, aliased=True, **kwargs), jdbc_predicates(partitions, row_hash)


def read_jdbc_tables(spark: SparkSession, connection: Mapping[str, str], **kwargs) -> ClinicalTables:
    """The five tables from a database; a failed connection raises on first read.

    Arguments are those of :func:`read_plan`.
    """
    frames = {}
    for name in SCHEMAS:
        options, predicates = read_plan(name, connection, **kwargs)
        if predicates is None:
            found = spark.read.format("jdbc").options(**options).load()
        else:
            url, table = options.pop("url"), options.pop("dbtable")
            found = spark.read.jdbc(url, table, predicates=predicates, properties=options)
        frames[name] = adapt_columns(found, name)
    return ClinicalTables(**frames)
