"""Recoding: ordered text buckets, numeric bins, code labels, ordered levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket_text(col: Column | str, patterns: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern that matches, ignoring case; order decides."""
    col = _col(col)
    chain = F
    for pattern, label in patterns:
        chain = chain.when(col.ilike(pattern), F.lit(label))
    return chain.otherwise(F.lit(default)) if patterns else F.lit(default)


def bin_numeric(
    col: Column | str, cuts: Sequence[float], labels: Sequence[str], null_bin: str = "last_bin"
) -> Column:
    """Bin ``x < cuts[0]``, ``x < cuts[1]``, ... and the rest into ``labels``.

    NULL fails every comparison and so lands in the last bin; ``null_bin="null"``
    keeps it NULL instead.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError("bin_numeric needs one more label than cut-points")
    if null_bin not in ("last_bin", "null"):
        raise ValueError(f"unknown null_bin {null_bin!r}")
    col = _col(col)
    chain = F.when(col.isNull(), F.lit(None).cast("string")) if null_bin == "null" else F
    for cut, label in zip(cuts, labels):
        chain = chain.when(col < cut, F.lit(label))
    return chain.otherwise(F.lit(labels[-1])) if cuts else F.lit(labels[-1])


def code_labels(col: Column | str, labels: Mapping[object, str]) -> Column:
    """Text for each code; unknown codes and NULL become NULL."""
    col = _col(col)
    chain = F
    for code, label in labels.items():
        chain = chain.when(col == F.lit(code), F.lit(label))
    return chain.otherwise(F.lit(None).cast("string"))


def keep_levels(col: Column | str, levels: Sequence[str]) -> Column:
    """The value when it is a declared level, else NULL."""
    col = _col(col)
    return F.when(col.isin(*levels), col)


def level_rank(col: Column | str, levels: Sequence[str]) -> Column:
    """Position of a value among its declared levels, NULL when it has none.

    Sort by ``level_rank(...).asc_nulls_last()`` to show levels in their own order.
    """
    chain = F
    for rank, level in enumerate(levels, start=1):
        chain = chain.when(_col(col) == level, F.lit(rank))
    return chain.otherwise(F.lit(None).cast("int")) if levels else F.lit(None).cast("int")


def number_from_text(col: Column | str) -> Column:
    """Parse text as a double; what is no number (``1-2``, ``NaN``) becomes NULL."""
    number = _col(col).try_cast("double")
    return F.when(~F.isnan(number), number)
