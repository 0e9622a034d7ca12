"""Exact quantiles by refining weighted histograms.

``percentile`` keeps a value-to-count map per group in one task. Here the values are
counted first (partial aggregation on the map side) and the counts are written once.
Then each wanted rank is narrowed down: the values between the bounds of its bracket
fall into a constant number of equal slices, the slice that holds the rank becomes the
new bracket, and its least and greatest value the new bounds. The bounds come from the
data, so an outlier costs one round. The rank is found when both bounds are the same.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.snapshot import scratch

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
#: Slices of a bracket. A window never sees more rows than this and four.
SLICES = 1024
#: Tasks over which the values of one group are spread when they meet their brackets.
SPREAD = 64


def value_counts(
    df: DataFrame, by: Sequence[str], measures: Sequence[str], keep_missing: bool = False
) -> DataFrame:
    """``by..., measure, value, n``: how often each known value of each measure occurs.

    One pass over ``df``; missing values and NaN are left out, or counted together as
    NULL with ``keep_missing``.
    """
    number = lambda m: F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))
    wide = df.select(*by, *[number(m).alias(m) for m in measures])
    long = wide.unpivot([F.col(c) for c in by], list(measures), "measure", "value")
    counted = long if keep_missing else long.where(F.col("value").isNotNull())
    return counted.groupBy(*by, "measure", "value").agg(F.count("*").alias("n"))


def _same(left: str, right: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def quantiles(
    counts: DataFrame, by: Sequence[str], probabilities: Mapping[str, float] = QUARTILES
) -> DataFrame:
    """Interpolated quantiles (type 7) of ``value`` weighted by ``n``, one row per ``by`` group.

    ``counts`` has the columns ``by..., value, n``; missing values weigh nothing, and a
    group without a value gives no row. Runs a small job per round of refinement.
    """
    return written_quantiles(scratch(counts.select(*by, "value", "n"), "counts"), by, probabilities)


def written_quantiles(
    counts: DataFrame, by: Sequence[str], probabilities: Mapping[str, float] = QUARTILES
) -> DataFrame:
    """:func:`quantiles` of counts that are cheap to read again."""
    by = list(by)
    known = counts.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("n") > 0))
    ranks = scratch(_whole_range(known, by, probabilities), "ranks")
    while not ranks.where("_low < _high").isEmpty():
        ranks = scratch(_narrowed(known, ranks, by), "ranks")
    found, results = [], []
    for i, name in enumerate(probabilities):
        at = lambda side: F.max(F.when(F.col("_id") == 2 * i + side, F.col("_low")))
        found += [at(0).alias(f"_low{i}"), at(1).alias(f"_high{i}")]
        found.append(F.max(F.when(F.col("_id") == 2 * i, F.col("_share"))).alias(f"_share{i}"))
        low, high, share = F.col(f"_low{i}"), F.col(f"_high{i}"), F.col(f"_share{i}")
        # an infinite neighbour that weighs nothing, or equals the other, must not give NaN
        between = F.when((share == 0) | (low == high), low).otherwise(low + (high - low) * share)
        results.append(between.alias(name))
    return ranks.groupBy(*by).agg(*found).select(*by, *results)


def _whole_range(known: DataFrame, by: list[str], probabilities: Mapping[str, float]) -> DataFrame:
    """``by..., _id, _rank, _share, _low, _high``: every wanted rank, its bracket the whole group.

    Each probability has a lower (even ``_id``) and an upper 0-based rank and the weight
    of the upper one.
    """
    whole = known.groupBy(*by).agg(
        F.sum("n").alias("_total"), F.min("value").alias("_low"), F.max("value").alias("_high")
    )
    wanted = []
    for i, probability in enumerate(probabilities.values()):
        place = F.lit(float(probability)) * (F.col("_total") - 1)
        share = (place - F.floor(place)).alias("_share")
        for side, rank in enumerate((F.floor(place), F.ceil(place))):
            rank_id = F.lit(2 * i + side).alias("_id")
            wanted.append(F.struct(rank_id, rank.cast("long").alias("_rank"), share))
    listed = whole.where(F.col("_total") > 0).withColumn("_wanted", F.explode(F.array(*wanted)))
    return listed.select(*by, "_wanted.*", "_low", "_high")


def _slice(value: Column, low: Column, high: Column) -> Column:
    """Number of the slice, growing with the value; the two bounds never share one.

    Halves keep the width finite; an infinite bound has a slice of its own.
    """
    most = F.lit(sys.float_info.max)
    least, greatest = F.greatest(low, -most), F.least(high, most)
    width = greatest / 2 - least / 2
    place = F.floor(F.try_divide(value / 2 - least / 2, width) * SLICES)
    inside = F.when(value <= least, 0).when(value >= greatest, SLICES + 1).otherwise(
        F.least(F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)), F.lit(SLICES))
    )
    return F.when(value < -most, -1).when(value > most, SLICES + 2).otherwise(inside)


def _narrowed(known: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """One round: the bracket of every open rank becomes the slice that holds the rank.

    Brackets are few and values many, so values are spread over slots and each bracket
    is sent to every slot of its group.
    """
    bounds = ["_low", "_high"]
    open_ranks = ranks.where("_low < _high")
    slots = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    brackets = open_ranks.select(*by, *bounds).distinct().withColumn("_slot", slots)
    slotted = known.withColumn("_slot", F.pmod(F.xxhash64("value"), F.lit(SPREAD)).cast("int"))
    meet = [*_same("v", "b", by), F.col("v._slot") == F.col("b._slot"), F.col("v.value").between(F.col("_low"), F.col("_high"))]
    held = slotted.alias("v").join(brackets.alias("b"), reduce(and_, meet))
    group = [F.col(f"b.{k}").alias(k) for k in by]
    sliced = held.select(*group, *bounds, "value", "n", _slice(F.col("value"), F.col("_low"), F.col("_high")).alias("_slice"))
    upto = Window.partitionBy(*by, *bounds).orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    histogram = (
        sliced.groupBy(*by, *bounds, "_slice")
        .agg(F.sum("n").alias("_size"), F.min("value").alias("_least"), F.max("value").alias("_greatest"))
        .withColumn("_before", F.sum("_size").over(upto) - F.col("_size"))
    )
    holds = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size"))
    found = open_ranks.alias("r").join(histogram.alias("h"), reduce(and_, [*_same("r", "h", by + bounds), holds]))
    narrower = found.select(
        *[F.col(f"r.{k}").alias(k) for k in by],
        "_id",
        (F.col("_rank") - F.col("_before")).alias("_rank"),
        "_share",
        F.col("_least").alias("_low"),
        F.col("_greatest").alias("_high"),
    )
    return ranks.where("_low = _high").unionByName(narrower)
