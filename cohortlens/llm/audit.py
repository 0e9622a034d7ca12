"""Filter interaction audit with count-weighted decision diagrams.

Each row has a mask of the filters that it fails. Masks are counted per part, so a part
is a table of 2^k counts at most, however many rows it has. A part's counts become a
decision diagram: a level per filter, a pass and a fail edge per node, equal
sub-diagrams shared, sub-diagrams without rows left out, and on each node the number of
rows that reach its function. In the diagram of an order, the path of pass edges from
the root gives the steps of that order: what its fail edges weigh goes, what its pass
edges weigh stays. One order is turned into the next by exchanging two adjacent levels,
which touches no node above or below them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Limits of the filters: least words, least percent of distinct words, most percent of A-Z.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
# What separates words, and marks that no text may hold.
GAP, MARKS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
COUNTS = ("rows", "good", "toxic")
STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long,"
    " unique_fails long, good_lost long, toxic_lost long, shapley long"
)
NOTHING = 0


class Diagram:
    """Counts by failure mask as a decision diagram whose levels can be exchanged.

    ``counts`` maps a mask (bit i: filter i fails) to a tuple of counts. Node 0 stands
    for no rows at all; it is the only one that skips levels.
    """

    def __init__(self, counts: Mapping[int, tuple[int, ...]], size: int, width: int = len(COUNTS)) -> None:
        self.order = list(range(size))
        self.low, self.high, self.weight = [NOTHING], [NOTHING], [(0,) * width]
        self.nodes: list[dict[tuple, int]] = [{} for _ in range(size)]
        self.leaves = {self.weight[0]: NOTHING}
        at = {mask: self._leaf(tuple(weight)) for mask, weight in counts.items()}
        for filter_ in reversed(range(size)):
            bit = 1 << filter_
            above = {mask & (bit - 1) for mask in at}
            at = {m: self._node(filter_, at.get(m, NOTHING), at.get(m | bit, NOTHING)) for m in above}
        self.root = at.get(0, NOTHING)

    def _new(self, low: int, high: int, weight: tuple[int, ...]) -> int:
        self.low.append(low)
        self.high.append(high)
        self.weight.append(weight)
        return len(self.low) - 1

    def _leaf(self, weight: tuple[int, ...]) -> int:
        if weight not in self.leaves:
            self.leaves[weight] = self._new(NOTHING, NOTHING, weight)
        return self.leaves[weight]

    def _node(self, filter_: int, low: int, high: int) -> int:
        if low == high == NOTHING:
            return NOTHING
        nodes = self.nodes[filter_]
        if (low, high) not in nodes:
            nodes[low, high] = self._new(low, high, tuple(a + b for a, b in zip(self.weight[low], self.weight[high])))
        return nodes[low, high]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next one.

        Nodes of the upper level keep their place and their rows, so nothing above
        changes; the nodes between them and the level after next are made anew.
        """
        upper, lower = self.order[level], self.order[level + 1]
        before, self.nodes[upper], self.nodes[lower] = self.nodes[upper], {}, {}
        for (low, high), node in before.items():
            passes = self._node(upper, self.low[low], self.low[high])
            fails = self._node(upper, self.high[low], self.high[high])
            self.low[node], self.high[node] = passes, fails
            self.nodes[lower][passes, fails] = node
        self.order[level : level + 2] = [lower, upper]

    def all_pass_path(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """Per level: its filter, the counts that pass, the counts that fail."""
        node = self.root
        for filter_ in self.order:
            yield filter_, self.weight[self.low[node]], self.weight[self.high[node]]
            node = self.low[node]


def adjacent_swaps(size: int) -> Iterator[int]:
    """Levels to exchange with the next so that every order of ``size`` filters comes up once.

    The last filter walks through all places of each order of the others, back and forth.
    """
    if size < 2:
        return
    down = True
    for inner in (*adjacent_swaps(size - 1), None):
        yield from reversed(range(size - 1)) if down else range(size - 1)
        if inner is not None:
            yield inner + 1 if down else inner
        down = not down


def audit_counts(counts: Mapping[int, tuple[int, int, int]], names: Sequence[str]) -> list[tuple]:
    """Steps of all orders, from counts by mask: rows of ``STEPS`` without the part."""
    size = len(names)
    diagram = Diagram(counts, size)
    walks = []
    for level in (None, *adjacent_swaps(size)):
        if level is not None:
            diagram.swap(level)
        walks.append([(f, kept, gone) for f, kept, gone in diagram.all_pass_path()])
    fails, alone, total = [0] * size, [0] * size, [0] * size
    for walk in walks:
        for place, (f, _, gone) in enumerate(walk):
            total[f] += gone[0]
            if place == 0:
                fails[f] = gone[0]
            if place == size - 1:
                alone[f] = gone[0]
    return [
        ("".join(names[f] for f, _, _ in walk), step, kept[0], gone[0], fails[f] - gone[0], alone[f], gone[1], gone[2], total[f])
        for walk in walks
        for step, (f, kept, gone) in enumerate(walk, start=1)
    ]


def text_filters(text: str) -> dict[str, Column]:
    """Failure conditions of the single-text filters, true where a text fails."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(whole, GAP), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(whole, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        "C": 100 * capitals > MOST_CAPITALS * F.length(whole),
        "D": whole.rlike(MARKS),
    }


def failure_masks(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column],
    copies: str | None = "E",
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """``part, mask, rows, good, toxic``: rows by the filters that they fail.

    Bit i of ``mask`` belongs to the i-th filter; the last is ``copies``: the text
    equals that of a smaller id anywhere in the table. Texts are compared by SHA-256.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        mask.cast("int").alias("mask"),
        F.sha2(whole, 256).alias("digest"),
    )
    # repeated rows become one, so that no id and no text is hot in what follows
    rows = rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("rows"))
    if copies is not None:
        least = rows.groupBy("digest").agg(F.min("id").alias("id"), F.count("id").alias("ids")).where("ids > 1")
        # a text of one id keeps it; of the others only the row of the smallest id is no copy
        kept = least.select(F.col("digest").alias("of"), F.col("id").alias("least"))
        rows = _flag_copies(rows, kept, 1 << len(filters))
    marks = labels.select(F.col("doc_id").cast("long").alias("key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.where("key is not null").groupBy("key").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # rows without an id have no label; they are spread instead of meeting at one null key
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest", "part")).otherwise(F.lit(0))
    known = rows.withColumn("spread", spread).join(
        marks.withColumn("nowhere", F.lit(0).cast("long")),
        (F.col("id") == F.col("key")) & (F.col("spread") == F.col("nowhere")),
        "left",
    )
    n = F.col("rows")
    return known.groupBy("part", "mask").agg(
        F.sum(n).alias("rows"),
        F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"),
    )


def _flag_copies(rows: DataFrame, kept: DataFrame, bit: int) -> DataFrame:
    """Add ``bit`` to the mask of rows whose text a smaller id has too.

    ``kept``: text (``of``) and smallest id (``least``) of the texts that several rows
    hold. Texts that many rows share are hot keys, so rows are sent by text and a slot of
    their id, and each kept text is sent to every slot.
    """
    slots = 32
    slot = F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int")
    everywhere = kept.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    met = rows.withColumn("own", slot).join(
        everywhere, (F.col("digest") == F.col("of")) & (F.col("own") == F.col("slot")), "left"
    )
    fails = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return met.select("id", "digest", "part", (F.col("mask") + F.when(fails, bit).otherwise(0)).alias("mask"), "rows")


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column] | None = None,
    copies: str | None = "E",
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """Steps of every order of the filters, per part: columns of ``STEPS``.

    ``filters`` maps a letter to a condition that is true where a row fails; ``copies``
    names the filter on equal texts, which comes last. All orders are walked, so filters
    should be few. A null text counts as empty, a null part as ``''``. A row without an
    id is never a copy and has no label; repeated rows count as often as they occur, and
    rows of one id and text are no copies of each other. An id with several labels is
    good or toxic if one of them says so. An empty table gives no rows; other columns of
    ``docs`` are ignored.
    """
    filters = text_filters(text) if filters is None else dict(filters)
    names = [*filters, *([copies] if copies is not None else [])]
    counted = failure_masks(docs, labels, filters, copies, doc_id, text, part)
    per_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [f.split() for f in STEPS.split(", ")]
        fields = pa.schema([(name, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[kind]) for name, kind in kinds])
        for batch in batches:
            for row in batch.to_pylist():
                counts = {c["mask"]: (c["rows"], c["good"], c["toxic"]) for c in row["counts"]}
                steps = [(row["part"], *step) for step in audit_counts(counts, names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*steps), fields)], schema=fields)

    return per_part.mapInArrow(run, STEPS)
