"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Statistics are column expressions. Trees are grown on the statistics of a labelled
sample; every path from a root to a node is a rule, a conjunction of comparisons. A
logistic model with a lasso penalty weighs the rules and leaves few of them. Those are
compiled into one column expression, so texts are scored where they are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: Labelled rows of either class that are learned from, at most (about).
SAMPLE = 20_000
TREES, DEPTH, PENALTY = 24, 3, 0.001
#: Score from which a text counts as good.
THRESHOLD = 0.7
SEED = 13

#: (statistic, bound, True where the rule asks for more than the bound)
Test = tuple[str, float, bool]


@dataclass(frozen=True)
class RuleModel:
    """Rules with weights; the score is the logistic function of their sum."""

    intercept: float
    weights: dict[tuple[Test, ...], float]

    def score(self, statistics: dict[str, Column]) -> Column:
        terms = [F.when(compiled(rule, statistics), weight).otherwise(0.0) for rule, weight in self.weights.items()]
        return 1 / (1 + F.exp(-reduce(add, terms, F.lit(self.intercept))))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a missing id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(2)) % 4 == 2


def _pieces(text: Column) -> dict[str, Column]:
    """Arrays and counts that several statistics use."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("double")
    return {
        "words": words,
        "lines": F.array_remove(F.split(text, "\n"), ""),
        "chars": F.length(text).cast("double"),
        "letters": left(r"\P{L}+"),
        "capitals": left(r"\P{Lu}+"),
        "digits": left(r"[^0-9]+"),
        "marks": left(r"[^.,;:!?'\"()-]+"),
        "symbols": left(r"[\p{L}\p{N}\s.,;:!?'\"()-]+"),
        "shouts": left(r"[^!]+"),
        "bars": left(r"[^|]+"),
    }


def _statistics() -> dict[str, Column]:
    """Statistics over the columns of :func:`_pieces`; 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    words, lines = F.size("words").cast("double"), F.size("lines").cast("double")
    chars = F.col("chars")
    distinct, different = F.size(F.array_distinct("words")), F.size(F.array_distinct("lines"))
    return {
        "log_words": F.log1p(words),
        "log_lines": F.log1p(lines),
        "word_length": share(chars, words),
        "line_words": share(words, lines),
        "distinct_words": share(distinct.cast("double"), words),
        "distinct_lines": share(different.cast("double"), lines),
        # texts of any length repeat some words; what is beyond that grows with the square root
        "word_variety": share(distinct.cast("double"), F.sqrt(words)),
        "letters": share(F.col("letters"), chars),
        "capitals": share(F.col("capitals"), F.col("letters")),
        "digits": share(F.col("digits"), chars),
        "marks": share(F.col("marks"), words),
        "symbols": share(F.col("symbols"), words),
        "shouts": share(F.col("shouts"), words),
        "bars": share(F.col("bars"), words),
    }


STATISTICS = (
    "log_words", "log_lines", "word_length", "line_words", "distinct_words", "distinct_lines", "word_variety",
    "letters", "capitals", "digits", "marks", "symbols", "shouts", "bars",
)


def with_statistics(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with a column per statistic in place of the text, evaluated once each."""
    others = [F.col(c) for c in rows.columns if c != text]
    pieces = rows.select(*others, *[c.alias(name) for name, c in _pieces(F.coalesce(F.col(text), F.lit(""))).items()])
    return pieces.select(*others, *[c.alias(name) for name, c in _statistics().items()])


def compiled(rule: tuple[Test, ...], statistics: dict[str, Column]) -> Column:
    """A rule as a column expression."""
    one = lambda t: statistics[t[0]] > t[1] if t[2] else statistics[t[0]] <= t[1]
    return reduce(and_, map(one, rule))


def simplified(path: list[Test]) -> tuple[Test, ...]:
    """A path with the tightest bound per statistic and side, in a fixed order."""
    tight: dict[tuple[str, bool], float] = {}
    for name, bound, above in path:
        old = tight.get((name, above))
        tight[name, above] = bound if old is None else max(old, bound) if above else min(old, bound)
    return tuple(sorted((name, bound, above) for (name, above), bound in tight.items()))


def tree_paths(described: str) -> list[tuple[Test, ...]]:
    """Paths from the roots to all nodes of trees, from their printed form.

    ``described`` has a line per branch, indented by its depth:
    ``If (feature 3 <= 0.5)`` or ``Else (feature 3 > 0.5)``.
    """
    paths: dict[tuple[Test, ...], None] = {}
    trail: list[tuple[int, Test]] = []
    for line in described.splitlines():
        indent = len(line) - len(line.lstrip())
        trail = [step for step in trail if step[0] < indent]
        branch = re.match(r"(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line.strip())
        if branch:
            trail.append((indent, (STATISTICS[int(branch[1])], float(branch[3]), branch[2] == ">")))
            paths[simplified([test for _, test in trail])] = None
    return list(paths)


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``row, label`` and statistics of a bounded sample of labelled rows that are not held out.

    Drawn by a hash of id and text at a rate that gives about ``SAMPLE`` of either class;
    an id with contradicting labels counts as bad.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("quality").cast("int").alias("quality"))
    known = known.where("key is not null and quality in (0, 1)").where(~held_out("key"))
    known = known.groupBy("key").agg(F.min("quality").alias("label"))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    # the join moves ids and hashes only; texts are read again where a row was drawn
    different = rows.select("id", F.xxhash64("id", "text").alias("row")).distinct()
    found = written(different.join(known, F.col("id") == F.col("key")).select("row", "label"), "labelled")
    sizes = dict(found.groupBy("label").count().collect())
    draw = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    rate = F.lit(0)
    for label in (0, 1):
        rate = F.when(F.col("label") == label, int(min(1.0, SAMPLE / max(1, sizes.get(label, 0))) * (1 << 30))).otherwise(rate)
    drawn = found.where(draw < rate).select("row", "label")  # about 2 * SAMPLE rows
    texts = rows.where("id is not null").where(~held_out("id")).select(F.xxhash64("id", "text").alias("row"), "text")
    picked = texts.join(F.broadcast(drawn), "row")
    sample = written(with_statistics(picked, "text"), "sample")
    # a fixed layout, so that the trees are the same however the rows were read
    return written(sample.repartition(8, "row").sortWithinPartitions("row"), "sample")


def learn_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> RuleModel:
    """Rules and weights from labelled rows; held-out rows are never read.

    If the sample holds one class only, or none, every text has the share of good rows
    (with half a row of either class added) as its score.
    """
    sample = _labelled(docs, labels, doc_id, text)
    sizes = dict(sample.groupBy("label").count().collect())
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    flat = RuleModel(math.log((good + 0.5) / (bad + 0.5)), {})
    if not good or not bad:
        return flat
    vectors = sample.select(F.col("label").cast("double").alias("label"), array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", minInstancesPerNode=2, seed=SEED)
    rules = tree_paths(forest.fit(vectors).toDebugString)
    if not rules:
        return flat
    columns = {name: F.col(name) for name in STATISTICS}
    # rows in which the same rules fire are one row with counts, which is all the fit needs
    fired = F.array(*[compiled(rule, columns).cast("tinyint") for rule in rules])
    counted = sample.groupBy(fired.alias("fired")).agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy("fired").toArrow()
    x = np.array(counted["fired"].to_pylist(), dtype=float)
    intercept, found = lasso_logistic(x, counted["good"].to_numpy().astype(float), counted["n"].to_numpy().astype(float))
    return RuleModel(intercept, {rule: float(w) for rule, w in zip(rules, found) if w})


def lasso_logistic(
    x: np.ndarray, good: np.ndarray, n: np.ndarray, penalty: float = PENALTY, rounds: int = 400, settled: float = 1e-6
) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean log loss plus ``penalty`` times the weights' size.

    Row i stands for ``n[i]`` observations, ``good[i]`` of class 1. Each round bounds the
    loss from above by a square and goes once through all weights, so the sum never rises.
    """
    total = n.sum()
    weights, bound = np.zeros(x.shape[1]), n / (4 * total)
    curvature = bound @ (x * x)
    intercept = float(np.log((good.sum() + 0.5) / (total - good.sum() + 0.5)))
    line = np.full(len(x), intercept)
    for _ in range(rounds):
        residual = (good - n / (1 + np.exp(-line))) / total  # falls by bound times each step along the line
        largest = 0.0
        step = residual.sum() / bound.sum()
        intercept, line, residual = intercept + step, line + step, residual - bound * step
        for j in np.flatnonzero(curvature > 0):
            pull = x[:, j] @ residual + curvature[j] * weights[j]
            new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / curvature[j]
            if step := new - weights[j]:
                weights[j] = new
                line = line + step * x[:, j]
                residual = residual - bound * step * x[:, j]
                largest = max(largest, abs(step))
        if largest < settled:
            break
    return intercept, weights


def score_quality(docs: DataFrame, model: RuleModel, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the number of rules that fired, per row of ``docs``.

    A null text counts as empty; its statistics are all 0 and it is scored like any
    other. Repeated rows and rows without an id come out as often as they go in, other
    columns are ignored, and an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = with_statistics(rows, "text")
    columns = {name: F.col(name) for name in STATISTICS}
    fired = reduce(add, (F.when(compiled(rule, columns), 1).otherwise(0) for rule in model.weights), F.lit(0))
    scored = rows.select("doc_id", held_out("doc_id").alias("held_out"), model.score(columns).alias("score"), fired.alias("rules"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "rules")
