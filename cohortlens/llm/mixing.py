"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Token weights of the cells (source, language, topic) are raked until their sums agree
with the target share of every source, language and topic. A document is drawn with the
probability that gives its cell its share of the wanted tokens. No document is drawn
twice: a cell with too few tokens either counts for more (``weight``), or the targets are
first brought within reach and the raking deals what such a cell lacks to the others.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

MARGINS = ("source", "lang", "topic")
#: Exponents of today's token shares that give the targets: below 1 lifts the rare ones.
TEMPERS = {"source": 0.7, "lang": 0.7, "topic": 0.9}
#: Share of all tokens to draw.
DRAWN = 0.5
SWEEPS, CLOSE = 20, 1e-4
NONE = "(none)"


def topic_of(text: str) -> Column:
    """Kind of a text: table, symbols, fragment, long or prose."""
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.greatest(F.length(body), F.lit(1))
    share = lambda marks: (F.length(body) - F.length(F.translate(body, marks, ""))) / size
    return (
        F.when(share("|\t") >= 0.01, "table")
        .when(share("#%&$*{}<>;=") >= 0.02, "symbols")
        .when(size < 200, "fragment")
        .when(size >= 8000, "long")
        .otherwise("prose")
    )


def _described(docs: DataFrame, doc_id: str, text: str, source: str, lang: str) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), name(source).alias("source"), name(lang).alias("lang"),
        _seed(doc_id, text).alias("seed"), topic_of(text).alias("topic"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+")).cast("long").alias("n_tokens"),
    )


def tempered(cells: DataFrame, margin: str, temper: float) -> DataFrame:
    """``margin, target``: shares proportional to a power of today's tokens."""
    now = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    lifted = now.select(margin, F.pow("tokens", F.lit(temper)).alias("lifted"))
    total = lifted.agg(F.sum("lifted")).first()[0] or 1.0
    return lifted.select(margin, (F.col("lifted") / total).alias("target"))


def within_reach(targets: DataFrame, cells: DataFrame, margin: str) -> DataFrame:
    """``margin, target``: no level is to give more than the ``most`` of its cells.

    What such levels lack is dealt to the others in proportion to their targets. A
    round raises the common factor of the others, which may fill further levels, so
    there are no more rounds than levels.
    """
    held = cells.groupBy(margin).agg(F.sum("most").alias("most"))
    levels = written(targets.join(held, margin), "levels")
    scale = 1.0
    while True:
        full = F.col("most") <= F.col("target") * scale
        fixed, free = levels.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("target")))).first()
        raised = (1.0 - (fixed or 0.0)) / free if free else scale
        if raised <= scale * (1 + 1e-12):
            return levels.select(margin, F.least(F.col("target") * scale, F.col("most")).alias("target"))
        scale = raised


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = SWEEPS, close: float = CLOSE) -> DataFrame:
    """``cells`` with ``weight``: fitted to the targets of each margin in turn.

    ``cells``: the margins, ``tokens`` and perhaps ``most``, which no weight exceeds:
    weights are cut there at every step, so the next one deals what is lacking to the
    other cells of the level. Levels without tokens keep weight 0. Sums are made and
    joined in Spark, so the number of cells is not bounded. Stops when every margin is
    within ``close``, or after ``sweeps`` rounds, with a warning that tells the gap,
    where empty or full cells leave no exact solution.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    bound = F.least(F.col("weight"), F.col("most")) if "most" in cells.columns else F.col("weight")
    goals = {m: written(t, "targets") for m, t in targets.items()}
    now = written(cells.withColumn("weight", F.col("tokens") / F.lit(float(total))), "cells")
    gap = 0.0
    for _ in range(sweeps):
        apart = F.lit(0.0)
        for margin, goal in goals.items():
            sums = now.groupBy(margin).agg(F.sum("weight").alias("held")).join(goal, margin, "left")
            factor = F.coalesce(F.try_divide("target", "held"), F.lit(0.0)).alias("factor")
            sums = sums.select(margin, factor, F.abs(F.coalesce("target", F.lit(0.0)) - F.col("held")).alias("gap"))
            now = now.join(sums, margin).withColumns({"weight": F.col("weight") * F.col("factor"), "apart": F.greatest(apart, "gap")})
            now, apart = now.withColumn("weight", bound).drop("factor", "gap"), F.col("apart")
        now = written(now, "cells")
        gap = now.agg(F.max("apart")).first()[0] or 0.0
        if gap <= close:
            break
    else:
        warnings.warn(f"raking has not settled after {sweeps} sweeps: a margin is {gap:.2g} from its target", stacklevel=2)
    return now.drop("apart")


def _fitted(described: DataFrame, tempers: Mapping[str, float], drawn: float, capped: bool) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Raked cells with ``wanted``, the tokens of each as a multiple of what it holds, and the targets."""
    cells = written(described.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    targets = {m: tempered(cells, m, t) for m, t in tempers.items()}
    if capped:
        cells = cells.withColumn("most", F.coalesce(F.try_divide(F.col("tokens"), F.lit(float(drawn * total))), F.lit(0.0)))
        targets = {m: within_reach(t, cells, m) for m, t in targets.items()}
    wanted = F.try_divide(F.col("weight") * F.lit(float(drawn * total)), F.col("tokens"))
    return rake(cells, targets).withColumn("wanted", wanted), targets


def mix_probabilities(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
    tempers: Mapping[str, float] = TEMPERS, drawn: float = DRAWN, capped: bool = False,
) -> DataFrame:
    """``source, lang, topic, tokens, probability, weight`` per cell.

    ``probability`` is at most 1; ``weight`` is what a drawn document counts for, more
    than 1 only where the cell has too few tokens for its share. Weighted tokens agree
    with the targets in expectation. With ``capped`` every document counts once: levels
    that have too few tokens are drawn whole, and the others make up for them. Cells
    without tokens have probability 1 and weight 1.
    """
    fitted, _ = _fitted(_described(docs, doc_id, text, source, lang), tempers, drawn, capped)
    rate = F.coalesce(F.least("wanted", F.lit(1.0)), F.lit(1.0)).alias("probability")
    weight = F.lit(1.0) if capped else F.coalesce(F.greatest("wanted", F.lit(1.0)), F.lit(1.0))
    return written(fitted.select(*MARGINS, "tokens", rate, weight.alias("weight")), "mix")


def mix_margins(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
    tempers: Mapping[str, float] = TEMPERS, drawn: float = DRAWN, capped: bool = False,
) -> DataFrame:
    """``margin, level, tokens, target, expected`` for every level of the margins.

    Shares of the tokens to draw: the target, and what is expected with the fitted
    probabilities (and weights, unless ``capped``). Levels without tokens have no target.
    """
    fitted, targets = _fitted(_described(docs, doc_id, text, source, lang), tempers, drawn, capped)
    total = fitted.agg(F.sum("tokens")).first()[0] or 0
    share = F.sum(F.coalesce(F.col("tokens") * F.col("wanted"), F.lit(0.0)))
    levels = None
    for margin, target in targets.items():
        sums = fitted.groupBy(margin).agg(F.sum("tokens").alias("tokens"), F.try_divide(share, F.lit(float(drawn * total))).alias("expected"))
        rows = sums.join(target, margin, "left").select(F.lit(margin).alias("margin"), F.col(margin).alias("level"), "tokens", "target", "expected")
        levels = rows if levels is None else levels.unionByName(rows)
    return levels


def _seed(doc_id: str, text: str) -> Column:
    """What a draw depends on: the id, or the text where there is no id."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.lit("text"), F.col(text)))


def _drawn(seed: Column, probability: Column) -> Column:
    """A hash of the seed decides, so a document is drawn or not whatever else there is."""
    return F.pmod(F.xxhash64(seed, F.lit("mix")), F.lit(1 << 52)) < probability * F.lit(float(1 << 52))


def mix_sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", **how) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, probability, weight`` of the drawn rows.

    A null source or language is a level ``(none)``; null and empty texts have no
    tokens. Rows that repeat an id are drawn together, rows without one by their text.
    Other columns are ignored.
    """
    cells = mix_probabilities(docs, doc_id, text, source, lang, **how).drop("tokens")
    rows = _described(docs, doc_id, text, source, lang).join(cells, list(MARGINS))
    rows = rows.where(_drawn(F.col("seed"), F.col("probability")))
    return rows.select("doc_id", *MARGINS, "n_tokens", "probability", "weight")


def keep_mixed(docs: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``docs`` (doc_id, text, source, lang) with their own columns.

    Kept rows count once, so the mix is ``capped`` unless told otherwise. The cell of a
    row is joined by names of its own, so no column of ``docs`` clashes.
    """
    cells = mix_probabilities(docs, **{"capped": True} | how)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    keyed = docs.select(F.struct("*").alias("_row"), _seed("doc_id", "text").alias("_seed"), name("source").alias("source"), name("lang").alias("lang"), topic_of("text").alias("topic"))
    rows = keyed.join(cells.select(*MARGINS, "probability"), list(MARGINS))
    return rows.where(_drawn(F.col("_seed"), F.col("probability"))).select("_row.*")
