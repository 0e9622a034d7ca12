"""0/1 flags per key from coded records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CodeRule


def _matches(rules: Sequence[CodeRule], code: str, ordinal: str) -> Column:
    def one(rule: CodeRule) -> Column:
        hit = F.col(code).startswith(rule.prefix)
        return hit if rule.after is None else hit & (F.col(ordinal) > rule.after)

    return reduce(or_, (one(rule) for rule in rules))


def flag_by_codes(
    records: DataFrame,
    key: str,
    rules: Mapping[str, Sequence[CodeRule]],
    code: str = "icd9_code",
    ordinal: str = "seq_num",
) -> DataFrame:
    """One row per key that fits any rule, with a 0/1 column per named rule set.

    All flags come from one scan and one aggregation. Records that fit no rule are
    dropped before it, and the prefix tests reach the file scan.
    """
    tests = {name: _matches(group, code, ordinal) for name, group in rules.items()}
    relevant = records.where(reduce(or_, tests.values()))
    hit = lambda test: F.max(F.when(test, 1).otherwise(0))
    return relevant.groupBy(key).agg(*[hit(test).alias(name) for name, test in tests.items()])


def left_flags(df: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """Attach flag columns; keys without a row get 0."""
    names = [c for c in flags.columns if c != key]
    joined = df.join(flags, key, "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in names})
