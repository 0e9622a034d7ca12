"""Categorical variables crossed with a column variable."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F


def crosstab(
    df: DataFrame,
    variables: Sequence[str],
    by: str,
    by_levels: Mapping[str, str],
    levels: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Counts and column percents of every level of every variable.

    ``by_levels`` maps each value of ``by`` to a column suffix. Output: ``variable,
    level, position`` and per suffix ``n_, pct_, total_``. Percents are of the rows
    where the variable is known; ``total_`` counts all rows of the column group.
    Declared ``levels`` appear even when no row has them, in their order
    (``position``); other values have no position.

    Rows are counted once per combination of all variables; only those counts are
    turned from wide to long.
    """
    combinations = df.where(F.col(by).isin(*by_levels)).groupBy(*variables, by).agg(
        F.count("*").alias("n")
    )
    texts = [F.col(v).cast("string").alias(v) for v in variables]
    long = combinations.select(by, "n", *texts).unpivot([by, "n"], list(variables), "variable", "level")
    rows = long.withColumn("position", F.lit(None).cast("int"))
    if any((levels or {}).values()):
        rows = rows.unionByName(_declared_levels(df, levels, by))

    counted = [
        F.coalesce(F.sum(F.when(F.col(by) == value, F.col("n"))), F.lit(0)).alias(f"n_{suffix}")
        for value, suffix in by_levels.items()
    ]
    cells = rows.groupBy("variable", "level").agg(F.max("position").alias("position"), *counted)
    variable = Window.partitionBy("variable")
    known, everyone = {}, {}
    for suffix in by_levels.values():
        n = F.col(f"n_{suffix}")
        known[f"_known_{suffix}"] = F.sum(F.when(F.col("level").isNotNull(), n)).over(variable)
        everyone[f"total_{suffix}"] = F.sum(n).over(variable)
    columns = []
    for suffix in by_levels.values():
        n, whole = F.col(f"n_{suffix}"), F.col(f"_known_{suffix}")
        share = F.when(whole > 0, F.round(100 * n / whole, 1))
        columns += [n, share.alias(f"pct_{suffix}"), F.col(f"total_{suffix}")]
    return (
        cells.withColumns(known | everyone)
        .where(F.col("level").isNotNull())
        .select("variable", "level", "position", *columns)
    )


def _declared_levels(df: DataFrame, levels: Mapping[str, Sequence[str]], by: str) -> DataFrame:
    """A zero count for each declared level: literals within the plan, ``by`` typed as in ``df``."""
    zeros = [
        F.struct(
            F.lit(None).cast(df.schema[by].dataType).alias(by),
            F.lit(0).cast("long").alias("n"),
            F.lit(variable).alias("variable"),
            F.lit(level).cast("string").alias("level"),
            F.lit(position).alias("position"),
        )
        for variable, names in levels.items()
        for position, level in enumerate(names, start=1)
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*zeros)))
