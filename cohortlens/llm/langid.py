"""Language identification by cross-parsing: longest matches against labelled text.

Per language a suffix automaton holds all substrings of a bounded sample of labelled
text. A text is cut greedily into phrases, each the longest match from where it
starts. The language that needs the fewest bits, phrases times log2 of its sample's
length, wins. Texts are parsed many at a time, one letter per step, with NumPy; the
parse starts anew every ``BLOCK`` letters, for all languages alike.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import held_out, shared

#: Bounds of the sample that is learned from: documents and letters per language,
#: letters per document, letters in all (shared equally where there are many languages).
SAMPLE_DOCS, SAMPLE_LETTERS, DOC_LETTERS, ALL_LETTERS = 400, 50_000, 400, 2_000_000
#: Columns of a language's dense table: its most frequent letters and one for all others, whose transitions are kept as a sorted list.
ALPHABET = 96
BLOCK = 512
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letters_of(text: str) -> np.ndarray:
    """Lower-case code points with every run of other characters as one space, none outside."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = np.where(letter, points, 32)[keep]
    return out[:-1] if len(out) and out[-1] == 32 else out


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at != -1 and symbol not in nexts[at]:
            nexts[at][symbol] = new
            at = link[at]
        if at != -1:
            to = nexts[at][symbol]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                link[to] = link[new] = twin
                while at != -1 and nexts[at].get(symbol) == to:
                    nexts[at][symbol] = twin
                    at = link[at]
        last = new
    return nexts


def _found(keys: np.ndarray, targets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The targets of the sorted keys that are wanted, 0 for those that are not there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, targets[at], 0)


class Parser:
    """Automata of all languages, each with codes of its own letters; built in each worker from the samples."""

    def __init__(self, samples: dict[str, list[np.ndarray]]) -> None:
        self.names = sorted(samples)
        counts: Counter = Counter()
        for parts in samples.values():
            for part in parts:
                points, n = np.unique(part, return_counts=True)
                counts.update(dict(zip(points.tolist(), n.tolist())))
        # a code for every letter of any sample; the last one is for letters of none
        self.code = np.full(0x110000, len(counts), dtype=np.int32)
        self.code[sorted(counts)] = np.arange(len(counts))
        self.tables, self.bits = [], []
        for name in self.names:
            own = Counter(np.concatenate([self.code[part] for part in samples[name]]).tolist())
            letters = sorted(own, key=lambda c: (-own[c], c))
            local = np.full(len(counts) + 1, len(letters), dtype=np.int32)
            local[letters] = np.arange(len(letters))
            symbols: list[int] = []
            for part in samples[name]:
                symbols += local[self.code[part]].tolist() + [-1]
            nexts = suffix_automaton(symbols)
            width = min(len(letters), ALPHABET - 1) + 1
            table, rare = np.zeros((len(nexts), width), dtype=np.int32), {}
            for state, to in enumerate(nexts):
                for symbol, target in to.items():
                    if 0 <= symbol < width - 1:
                        table[state, symbol] = target
                    elif symbol >= 0:
                        rare[state * len(letters) + symbol] = target
            keys = np.array(sorted(rare), dtype=np.int64)
            targets = np.array([rare[key] for key in keys.tolist()], dtype=np.int32)
            self.tables.append((local, width, len(letters), table.ravel(), keys, targets))
            self.bits.append(math.log2(max(2, len(symbols))))

    def phrases(self, blocks: list[np.ndarray]) -> np.ndarray:
        """Phrases of each block of codes (rows) for each language (columns)."""
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        steps = np.zeros((int(sizes.max(initial=0)), len(blocks)), dtype=np.int64)
        for column, i in enumerate(order):
            steps[: sizes[i], column] = blocks[i]
        active = np.searchsorted(-sizes[order], -np.arange(len(steps)), side="left")
        out = np.zeros((len(blocks), len(self.names)), dtype=np.int64)
        for k, (local, width, letters, table, keys, targets) in enumerate(self.tables):
            state = np.zeros(len(blocks), dtype=np.int64)
            count = np.zeros(len(blocks), dtype=np.int64)
            for row, n in zip(steps, active):
                code, now = local[row[:n]], state[:n]
                column = np.minimum(code, width - 1)
                to, first = table[now * width + column], table[column]
                if len(keys):
                    rare = np.flatnonzero((code >= width - 1) & (code < letters))
                    to[rare] = _found(keys, targets, now[rare] * letters + code[rare])
                    first[rare] = _found(keys, targets, code[rare])
                fresh = to == 0
                count[:n] += fresh | (now == 0)
                state[:n] = np.where(fresh, first, to)
            out[order, k] = count
        return out

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        blocks, owner, size, known = [], [], np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            codes = self.code[letters_of(text or "")]
            size[i], known[i] = len(codes), len(codes) > 0 and bool(self.names)
            for at in range(0, len(codes) if known[i] else 0, BLOCK):
                blocks.append(codes[at : at + BLOCK])
                owner.append(i)
        total = np.zeros((len(texts), max(1, len(self.names))))
        if blocks:
            np.add.at(total, owner, self.phrases(blocks))
        for i in range(len(texts)):
            if not known[i]:
                yield "und", 0.0
                continue
            cost = total[i] * self.bits / size[i]
            best = int(np.argmin(cost))
            yield self.names[best], float(1 / np.exp(-8 * (cost - cost[best])).sum())


_PARSERS: dict[int, Parser] = {}


def _parser(samples) -> Parser:
    """One parser per worker process and model."""
    if samples.value["id"] not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[samples.value["id"]] = Parser(samples.value["texts"])
    return _PARSERS[samples.value["id"]]


def learn_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"):
    """Bounded samples of text per language, from rows that are not held out.

    Rows are drawn by a hash of id and text, at a rate that gives about twice
    ``SAMPLE_DOCS`` per language; of each, a window of letters at a hashed place. Equal
    rows count once. Each language is cut to its letters in Spark, so the driver gets
    ``ALL_LETTERS`` at most.
    """
    spark = docs.sparkSession
    # names of this module's own, so that nothing clashes with the columns of docs
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(~held_out() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("lang")), F.lit(1 << 30))
    rates = [(r["lang"], int(min(1.0, 2 * SAMPLE_DOCS / r["n"]) * (1 << 30))) for r in sizes]
    rated = rows.join(F.broadcast(spark.createDataFrame(rates, "lang string, rate long")), "lang")
    drawn = rated.where(draw < F.col("rate")).select("lang", draw.alias("draw"), "text")
    window = drawn.mapInArrow(_windows, "lang string, draw long, points binary").where(F.length("points") > 0).distinct()
    most = min(SAMPLE_LETTERS, ALL_LETTERS // max(1, len(sizes)))
    texts: dict[str, list[np.ndarray]] = {}
    # some 2 * SAMPLE_DOCS rows of a language; four bytes are a letter
    so_far = Window.partitionBy("lang").orderBy("draw", "points").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = window.withColumn("upto", F.sum(F.length("points")).over(so_far)).where(F.col("upto") <= 4 * most)
    for row in cut.select("lang", "draw", "points").orderBy("draw", "lang", "points").collect():
        texts.setdefault(row["lang"], []).append(np.frombuffer(row["points"], dtype=np.uint32))
    return shared(spark, {"id": uuid.uuid4().hex, "texts": texts})


def _windows(batches):
    for batch in batches:
        points = []
        for text, draw in zip(batch.column("text"), batch.column("draw")):
            letters = letters_of(text.as_py() or "")
            at = draw.as_py() % max(1, len(letters) - DOC_LETTERS + 1)
            points.append(letters[at : at + DOC_LETTERS].astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), pa.array(points, pa.binary())], ["lang", "draw", "points"])


def _predict(samples):
    def run(batches):
        for batch in batches:
            parser = _parser(samples)
            names, scores, chunk, size = [], [], [], 0
            for text in [*batch.column(2), None]:
                if text is not None:
                    chunk.append(text.as_py())
                    size += len(chunk[-1] or "")
                if chunk and (text is None or size > CHUNK):
                    for name, score in parser.predict(chunk):
                        names.append(name)
                        scores.append(score)
                    chunk, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identify_language(docs: DataFrame, samples, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs``, from its whole text.

    ``samples`` come from ``learn_languages``. A null text, one without a letter, and
    every text when no language was learned, is ``und`` with score 0. Ties go to the
    name that sorts first. Score: the winner's share of 2^-cost-like weights, between
    1 / languages and 1. Repeated rows come out as often as they go in; other columns
    are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(samples), "doc_id long, held_out boolean, lang_pred string, score double")
