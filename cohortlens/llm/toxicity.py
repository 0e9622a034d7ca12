"""Toxicity: a learned lexicon, misspellings by Levenshtein automata, context of each hit.

The lexicon is learned from labelled rows: words, and stems of words, that occur in
toxic texts far more often than chance. Its trie is intersected with the Levenshtein
automata of all its terms; the product is made deterministic once, so that a word is
looked up in as many steps as it has letters, all words of a batch at a time. Each hit
looks at its surroundings: inside quotation marks or beside a reporting word it counts
as a quotation. A logistic model over the hits' weights gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, mixed, shared, written
from .shingles import shingle_sets, slices

#: Bounds of the labelled sample (documents of either class) and of the lexicon.
SAMPLE_TOXIC, SAMPLE_CLEAN, TERMS = 5_000, 15_000, 1_000
STEMS = range(4, 9)
#: Terms from this length on are also found with one letter wrong, stems from the second.
FUZZY_FROM, FUZZY_STEM = 5, 6
#: A misspelt term counts by this share of its weight.
MISSPELT = 0.5
LONGEST = 64
WINDOW_WORDS, WINDOW_CHARS = 6, 120
WORD = re.compile(r"\w+")
# Marks that open and close quotations, and words that report speech.
OPENING, CLOSING = "\"“„«‹‘", "\"”“»›’"
REPORTING = frozenset(
    "said says say quote quoted quotes quoting called calls term word words wrote tweeted "
    "dit mot cite citation terme sagte wort zitat nannte dijo palabra cita llamó".split()
)


def features_of(text: str) -> set[str]:
    """Words of a text, and their beginnings with a mark of their own."""
    words = set(WORD.findall(text.lower()))
    out = {w for w in words if 2 < len(w) <= 32}
    for word in words:
        for size in STEMS:
            if len(word) > size:
                out.add(word[:size] + "*")
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (part for batch in batches for part in slices(batch, "text")):
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(part.column("text"), part.column("toxic")):
            found[toxic.as_py()].update(features_of(text.as_py() or ""))
        names = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([found[1][f] for f in names], pa.int64()), pa.array([found[0][f] for f in names], pa.int64())],
            ["feature", "p", "q"],
        )


class Lexicon:
    """Terms and stems, and the deterministic product of their trie and automata."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.terms = sorted(weights)
        children: list[dict[str, int]] = [{}]
        ends: list[int] = [-1]
        deepest = [0]  # longest term below a node decides whether an error is worth following
        for k, term in enumerate(self.terms):
            at, size = 0, len(term.rstrip("*"))
            deepest[0] = max(deepest[0], size)
            for letter in term.rstrip("*"):
                if letter not in children[at]:
                    children[at][letter] = len(children)
                    children.append({})
                    ends.append(-1)
                    deepest.append(0)
                at = children[at][letter]
                deepest[at] = max(deepest[at], size)
            ends[at] = k if ends[at] < 0 or not term.endswith("*") else ends[at]
        self.letters = sorted({c for t in self.terms for c in t.rstrip("*")})
        self._product(children, ends, deepest)

    def _product(self, children, ends, deepest) -> None:
        def closed(pairs: dict[int, int]) -> frozenset:
            """Fewest errors per trie node, after skipping letters of the term."""
            best = dict(pairs)
            for node, errors in pairs.items():
                if errors == 0:
                    for child in children[node].values():
                        if deepest[child] >= FUZZY_FROM:
                            best[child] = min(best.get(child, 1), 1)
            return frozenset(best.items())

        def after(state: frozenset, letter: str | None) -> frozenset:
            out: dict[int, int] = {}
            for node, errors in state:
                to = children[node].get(letter)
                if to is not None:
                    out[to] = min(out.get(to, errors), errors)
                if errors == 0 and deepest[node] >= FUZZY_FROM:
                    out[node] = min(out.get(node, 1), 1)  # a letter too many
                    for child in children[node].values():  # a wrong letter
                        if deepest[child] >= FUZZY_FROM:
                            out[child] = min(out.get(child, 1), 1)
            return closed(out)

        states = {frozenset(): 0, closed({0: 0}): 1}
        queue, rows = [s for s in states], []
        for state in queue:
            row = []
            possible = {c for node, _ in state for c in children[node]}
            other = after(state, None)
            for letter in [*self.letters, None]:
                to = after(state, letter) if letter in possible else other
                if to not in states:
                    states[to] = len(states)
                    queue.append(to)
                row.append(states[to])
            rows.append(row)
        self.table = np.array(rows, dtype=np.int32)
        # what a word that ends in a state matches: term + 1, negative with an error
        self.ends_word = np.zeros(len(queue), dtype=np.int32)
        self.ends_stem = np.zeros(len(queue), dtype=np.int32)
        for i, state in enumerate(queue):
            for node, errors in sorted(state, key=lambda pair: (-pair[1], pair[0])):
                k = ends[node]
                if k < 0:
                    continue
                if errors and len(self.terms[k]) < (FUZZY_STEM + 1 if self.terms[k].endswith("*") else FUZZY_FROM):
                    continue
                target = self.ends_stem if self.terms[k].endswith("*") else self.ends_word
                target[i] = -(k + 1) if errors else k + 1

    def match(self, words: list[str]) -> np.ndarray:
        """Term + 1 per word, negative where one letter is wrong, 0 without a match."""
        if not words or not self.terms:
            return np.zeros(len(words), dtype=np.int32)
        grid = np.array([w[:LONGEST] for w in words], dtype=f"U{LONGEST}")
        points = grid.view(np.uint32).reshape(len(words), LONGEST)
        known = np.array([ord(c) for c in self.letters], dtype=np.uint32)
        place = np.searchsorted(known, points).clip(0, len(known) - 1)
        codes = np.where(known[place] == points, place, len(known))
        sizes = np.array([min(len(w), LONGEST) for w in words])
        state = np.ones(len(words), dtype=np.int64)
        stem = np.zeros(len(words), dtype=np.int32)
        for step in range(int(sizes.max())):
            live = np.flatnonzero((sizes > step) & (state > 0))
            state[live] = self.table[state[live], codes[live, step]]
            here = self.ends_stem[state[live]]
            better = (here != 0) & ((stem[live] == 0) | (stem[live] < 0) & (here > 0))
            stem[live[better]] = here[better]
        whole = self.ends_word[state]
        whole[[len(w) > LONGEST for w in words]] = 0
        return np.where(whole > 0, whole, np.where(stem > 0, stem, np.where(whole != 0, whole, stem)))


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray
    innocent: frozenset = frozenset()

    def signals(self, texts: list[str | None]) -> np.ndarray:
        """Per text: weight of exact, misspelt and quoted hits, hits per 100 words."""
        out = np.zeros((len(texts), 4))
        tokens = [WORD.findall((t or "").lower()) for t in texts]
        words = list(set().union(*tokens)) if tokens else []
        hits = {w: int(k) for w, k in zip(words, self.lexicon.match(words)) if k > 0 or k and w not in self.innocent}
        for i, own in enumerate(tokens):
            if hits and not hits.keys().isdisjoint(own):
                out[i] = self._context((texts[i] or "").lower(), own, hits)
        return out

    def _context(self, text: str, tokens: list[str], hits: dict[str, int]) -> np.ndarray:
        """Weights of distinct terms by kind of hit; a term counts by its plainest use."""
        kinds: dict[int, tuple[int, float]] = {}
        found = 0
        for at, match in enumerate(WORD.finditer(text)):
            k = hits.get(match.group())
            if k is None:
                continue
            found += 1
            before = text[max(0, match.start() - WINDOW_CHARS) : match.start()]
            behind = text[match.end() : match.end() + WINDOW_CHARS]
            near = tokens[max(0, at - WINDOW_WORDS) : at + WINDOW_WORDS + 1]
            kind = 2 if _quoted(before, behind) or not REPORTING.isdisjoint(near) else 0 if k > 0 else 1
            kinds[abs(k)] = min(kinds.get(abs(k), (3, 0.0)), (kind, 0.0))
        sums = np.zeros(4)
        for k, (kind, _) in kinds.items():
            sums[kind] += self.lexicon.weights[self.lexicon.terms[k - 1]]
        sums[3] = min(5.0, 100 * found / max(1, len(tokens)))
        return np.concatenate([np.minimum(sums[:3], 20.0), sums[3:]])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.probability(self.signals(texts))

    def probability(self, signals: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.coefficients[0] + design(signals) @ self.coefficients[1:])))


def design(signals: np.ndarray) -> np.ndarray:
    """What the logistic model sees: plain weight, quoted weight, density."""
    return np.column_stack([signals[:, 0] + MISSPELT * signals[:, 1], signals[:, 2:]])


def _quoted(before: str, behind: str) -> bool:
    """An odd mark opens before and one closes behind, both on the same line."""
    before, behind = before.rsplit("\n", 1)[-1], behind.split("\n", 1)[0]
    opened = [c for c in before if c in OPENING or c in CLOSING]
    return len(opened) % 2 == 1 and any(c in CLOSING for c in behind)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of a bounded sample of labelled rows that are not held out.

    Drawn by a hash of id and text at a rate that gives about the bound of either class,
    so an id with many texts gives no more rows than others; repeated rows are one row.
    Contradicting labels of an id count as toxic.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    row = F.xxhash64("doc_id", "text", F.col("text").isNull())
    # only ids and hashes are shuffled here; texts are read again where a row was drawn
    different = rows.select("doc_id", row.alias("row")).distinct()
    found = written(different.join(known, "doc_id").select("row", "toxic"), "labelled")
    sizes = dict(found.groupBy("toxic").count().collect())
    draw = F.pmod(F.xxhash64("row", F.lit("toxic")), F.lit(1 << 30))
    rate = F.lit(0)
    for toxic, bound in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC)):
        share = int(min(1.0, bound / max(1, sizes.get(toxic, 0))) * (1 << 30))
        rate = F.when(F.col("toxic") == toxic, F.lit(share)).otherwise(rate)
    drawn = found.where(draw < rate)  # about SAMPLE_CLEAN + SAMPLE_TOXIC rows at most
    texts = rows.where("doc_id is not null").where(~held_out()).select(row.alias("row"), "text")
    picked = texts.join(F.broadcast(drawn), "row")
    signed = picked.mapInArrow(_signed, "text string, toxic int, row long, m0 long, m1 long, m2 long")
    return _one_of_copies(written(signed.dropDuplicates(["row"]), "sample"))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least hashes of the shingles of a text, under three hash functions; a task gives a row once."""
    seen: set[int] = set()
    for part in (part for batch in batches for part in slices(batch, "text")):
        new = [i for i, row in enumerate(part.column("row").to_pylist()) if row not in seen and not seen.add(row)]
        part = part.take(pa.array(new, pa.int64()))
        least = np.zeros((3, part.num_rows), dtype=np.uint64)
        for i, tokens in enumerate(shingle_sets(part.column("text"), 5)):
            for k in range(3):
                least[k, i] = mixed(tokens ^ np.uint64(k)).min(initial=np.uint64(2**64 - 1))
        columns = [part.column("text"), part.column("toxic"), part.column("row"), *(pa.array(m.view(np.int64)) for m in least)]
        yield pa.RecordBatch.from_arrays(columns, ["text", "toxic", "row", "m0", "m1", "m2"])


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """Without most of the near copies: what copies repeat is no evidence about words."""
    kept = sample.drop("text")
    for name in ("m0", "m1", "m2"):
        kept = kept.groupBy("toxic", name).agg(F.min_by(F.struct("row", "m0", "m1", "m2"), "row").alias("r")).select("toxic", "r.row", *(f"r.{m}" for m in ("m0", "m1", "m2") if m != name), *([F.col(name)]))
    return sample.join(F.broadcast(kept.select("toxic", "row")), ["toxic", "row"]).select("text", "toxic")


def _share(p, all_p, q, all_q):
    return math.log((p + 0.5) / (all_p - p + 0.5)) - math.log((q + 0.5) / (all_q - q + 0.5))


def choose_terms(counted: list[tuple[str, int, int, float]], toxic: int, clean: int) -> dict[str, float]:
    """From the best feature on: drop those that overlap a chosen stem or word."""
    chosen: dict[str, float] = {}
    stems: set[str] = set()
    begun: set[str] = set()
    for feature, p, q, _ in sorted(counted, key=lambda r: (-r[3], r[0].endswith("*"), -len(r[0]), r[0])):
        bare = feature.rstrip("*")
        if any(bare[:n] in stems for n in range(1, len(bare) + 1)) or feature.endswith("*") and bare in begun:
            continue
        chosen[feature] = min(8.0, _share(p, toxic, q, clean))
        begun.update(bare[:n] for n in range(1, len(bare) + 1))
        if feature.endswith("*"):
            stems.add(bare)
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Newton steps with a small penalty, which keeps separable data finite."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_toxicity(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and model from labelled rows; held-out rows are never read.

    A feature joins the lexicon if its log-likelihood ratio exceeds what the best of a
    hundred features per document would reach by chance. Without toxic rows every text scores 0.
    """
    sample = _labelled(docs, labels)
    sizes = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Model(Lexicon({}), np.array([-30.0, 0, 0, 0]))
    counted = sample.mapInArrow(_count, "feature string, p long, q long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    part = lambda n, a, b: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) * (toxic + clean) / ((F.col("p") + F.col("q")) * b))).otherwise(0.0)
    ratio = 2 * (part("p", "q", toxic) + part("q", "p", max(1, clean)))
    often = counted.where(f"p >= 3 and p * {max(1, clean)}L > 4 * (q + 0.5) * {toxic}").withColumn("ratio", ratio)
    best = often.where(F.col("ratio") > 2 * math.log(100 * (toxic + clean))).orderBy(F.desc("ratio"), "feature").limit(20 * TERMS)
    counted_rows = [tuple(r) for r in best.collect()]
    weights = choose_terms(counted_rows, toxic, clean)
    model = Model(Lexicon(dict(sorted(weights.items(), key=lambda t: (-t[1], t[0]))[:TERMS])), np.zeros(4))
    lexicon = shared(docs.sparkSession, model.lexicon)

    def near_words(batches):
        for part in (part for batch in batches for part in slices(batch, "text")):
            words = list(set().union(*(WORD.findall((t or "").lower()) for t in part.column("text").to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, k in zip(words, lexicon.value.match(words)) if k < 0], pa.string())], ["word"])

    # no more words than the sample holds and than there are one letter off a term
    near = sample.where("toxic = 0").mapInArrow(near_words, "word string").distinct()
    model.innocent = frozenset(r["word"] for r in near.collect())
    held = shared(docs.sparkSession, model)

    def signal_rows(batches):
        for part in (part for batch in batches for part in slices(batch, "text")):
            x = held.value.signals(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("toxic"), *(pa.array(c) for c in x.T)], ["toxic", "a", "b", "c", "d"])

    kinds = "toxic int, a double, b double, c double, d double"
    grouped = sample.mapInArrow(signal_rows, kinds).toPandas()
    for done in (lexicon, held):
        done.destroy()
    y = grouped["toxic"].to_numpy(float)
    model.coefficients = fit_logistic(design(grouped[["a", "b", "c", "d"]].to_numpy(float)), y)
    return model


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, exact, misspelt, quoted`` per row of ``docs``.

    A null or empty text has no hit and gets the score of such texts. Repeated rows come
    out as often as they go in; other columns are ignored.
    """
    held = shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                x = held.value.signals(part.column(2).to_pylist())
                score = held.value.probability(x)
                columns = [score, (score >= 0.5).astype(np.int32), x[:, 0], x[:, 1], x[:, 2]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c) for c in columns)],
                    ["doc_id", "held_out", "score", "predicted", "exact", "misspelt", "quoted"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", held_out().alias("held_out"), "text")
    kinds = "doc_id long, held_out boolean, score double, predicted int, exact double, misspelt double, quoted double"
    return rows.mapInArrow(run, kinds)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score stays below 0.5, with all their columns."""
    held = shared(docs.sparkSession, model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [held.value.scores(part.column(0).to_pylist()) for part in slices(batch, 0)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(score(F.col(text)) < 0.5)
