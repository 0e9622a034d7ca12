"""Whitening, filter audit and quality rules against brute force on small tables."""

from __future__ import annotations

import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import audit, quality, whitening

VECTORS = "vec_id long, embedding array<float>, x string, n string, component string"


def vectors(spark, rows):
    """Rows (id, vector) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], VECTORS)


def draw(seed, n, d):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.logspace(0, 2, d) + 3).astype(np.float32)


def test_whitening_equals_an_eigendecomposition(spark):
    data = draw(1, 300, 20)
    given = [(i, v.tolist()) for i, v in enumerate(data)]
    given += [(1000 + i, data[0].tolist()) for i in range(150)]  # copies count once in the fit
    given += [(7, data[7].tolist()), (None, data[9].tolist())]
    given += [(2000, None), (2001, [None] * 20), (2002, [math.nan] * 20), (2003, [math.inf] + [0.0] * 19), (2004, [1.0]), (2005, [])]
    got = whitening.whiten(vectors(spark, given)).collect()
    x = np.floor(64 * data.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = [(i, v) for i, v in given if v is not None and len(v) == 20 and all(c is not None and math.isfinite(c) for c in v)]
    assert len(got) == 16 * len(kept)
    assert {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 17))
    assert max(r["identity_error"] for r in got) < 1e-9
    by_id = {}
    for r in got:
        by_id.setdefault((r["vec_id"], r["component"]), []).append(r)
    for i, v in kept:
        row = np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
        deviation = sum(int(n * a - b) ** 2 for a, b in zip(row.tolist(), sums.tolist()))
        for k in range(16):
            found = by_id[i, k + 1]
            assert len(found) == (2 if i == 7 else 1)
            assert found[0]["deviation"] == deviation
            assert found[0]["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
            want = (row - sums / n) @ axes[:, k] / math.sqrt(values[k])
            assert abs(found[0]["whitened"]) == pytest.approx(abs(want), rel=1e-6, abs=1e-6)


def test_whitening_where_directions_are_missing(spark):
    """Constant and repeated dimensions, fewer vectors than dimensions, scales far apart."""
    base = draw(2, 40, 3)
    rows = [(i, [float(a), float(b), 5.0, float(a), float(c) * 1000]) for i, (a, b, c) in enumerate(base)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2, 3}
    assert max(r["identity_error"] for r in got) < 1e-6
    assert sum({r["component"]: r["explained"] for r in got}.values()) == pytest.approx(1)
    few = [(i, v.tolist()) for i, v in enumerate(draw(3, 4, 9))]
    got = whitening.whiten(vectors(spark, few)).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and max(r["identity_error"] for r in got) < 1e-6


def test_whitening_of_nothing_and_of_one_vector(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_deviations_are_exact_beyond_floating_point():
    wide = np.array([[3_000_000_019, 1], [2_000_000_011, 7]], dtype=np.int64)
    assert whitening._deviations(wide) == [3_000_000_019**2 + 1, 2_000_000_011**2 + 49]
    assert whitening._deviations(np.array([[4_000_000_000] * 2], dtype=np.int64)) == [None]


def test_triangular_solve():
    upper = np.triu(np.random.default_rng(4).normal(size=(6, 6))) + 4 * np.eye(6)
    rows = np.random.default_rng(5).normal(size=(9, 6))
    assert np.allclose(whitening.solve_rows(rows, upper) @ upper, rows)


def brute_steps(counts, names):
    """Steps of all orders by going through the masks again for each."""
    out = []
    for order in itertools.permutations(range(len(names))):
        left = dict(counts)
        for step, f in enumerate(order, start=1):
            gone = [w for m, w in left.items() if m >> f & 1]
            left = {m: w for m, w in left.items() if not m >> f & 1}
            fails = sum(w[0] for m, w in counts.items() if m >> f & 1)
            alone = counts.get(1 << f, (0, 0, 0))[0]
            removed = [sum(w[k] for w in gone) for k in range(3)]
            kept = sum(w[0] for w in left.values())
            out.append(["".join(names[g] for g in order), step, kept, removed[0], fails - removed[0], alone, removed[1], removed[2], f])
    total = [sum(r[3] for r in out if r[-1] == f) for f in range(len(names))]
    return sorted((*r[:-1], total[r[-1]]) for r in out)


def test_diagrams_equal_brute_force():
    rng = np.random.default_rng(6)
    for size in range(1, 6):
        for _ in range(6):
            masks = rng.choice(1 << size, int(rng.integers(1, (1 << size) + 1)), replace=False)
            counts = {int(m): tuple(int(c) for c in rng.integers(0, 4, 3)) for m in masks}
            assert sorted(audit.audit_counts(counts, "ABCDE"[:size])) == brute_steps(counts, "ABCDE"[:size])


def test_adjacent_swaps_reach_every_order_once():
    for size in range(1, 7):
        order = list(range(size))
        seen = {tuple(order)}
        swaps = list(audit.adjacent_swaps(size))
        for level in swaps:
            order[level], order[level + 1] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(size) == len(swaps) + 1


def test_equal_sub_diagrams_are_shared():
    """Filters that fail independently of each other need one node a level, not 2^level."""
    diagram = audit.Diagram({m: (1, 0, 0) for m in range(32)}, 5)
    assert [len(nodes) for nodes in diagram.nodes] == [1] * 5
    diagram.swap(2)
    assert [len(nodes) for nodes in diagram.nodes] == [1] * 5


def audit_tables(spark):
    good = " ".join(f"word{i}" for i in range(250))
    texts = [None, "", "   ", good, good, good + " #", "A" * 50 + " " + good, "same " * 300, "x", "X", "é" * 10 + " " + good, good + " tail " * 3000]
    docs, labels = [], []
    for i, text in enumerate(texts * 2):
        docs.append((i, text, ["a", "b", None, ""][i % 4], "m", "p"))
        labels.append((i, i % 3 % 2, i % 2))
    docs += [(3, good, "a", "m", "p"), (3, good, "b", "m", "p"), (None, good, "a", "m", "p"), (None, good, "a", "m", "p"), (-5, "x", "c", "m", "p")]
    labels += [(3, 1, 1), (None, 1, 1), (99, 1, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, source string, mask string, part string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        docs,
        labels,
    )


def test_audit_equals_brute_force(spark):
    docs, labels, rows, marks = audit_tables(spark)
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    parts = {}
    for i, text, source, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            re.search(r"[#$%&*|]", t) is not None,
            i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows),
        ]
        counts = parts.setdefault(source or "", {})
        mask = sum(1 << k for k, f in enumerate(fails) if f)
        old = counts.get(mask, (0, 0, 0))
        counts[mask] = (old[0] + 1, old[1] + (i in good), old[2] + (i in toxic))
    want = sorted((p, *step) for p, counts in parts.items() for step in brute_steps(counts, "ABCDE"))
    assert sorted(map(tuple, audit.audit_filters(docs, labels).collect())) == want


def test_audit_of_other_filters_and_of_nothing(spark):
    docs, labels, rows, _ = audit_tables(spark)
    got = audit.audit_filters(docs, labels, {"S": F.length("text") < 5}, copies=None).collect()
    short = sum(text is not None and len(text) < 5 for _, text, *_ in rows)
    assert sum(r["removed"] for r in got) == short and sum(r["kept"] for r in got) == len(rows) - short
    assert audit.audit_filters(docs.limit(0), labels).collect() == []


@pytest.fixture(scope="module")
def graded(spark):
    """Texts with bars or shouting are bad, so are texts that say one word over and over."""
    rng = np.random.default_rng(7)
    docs, labels = [], []
    for i in range(600):
        words = [f"wort{rng.integers(500)}" for _ in range(int(rng.integers(5, 120)))]
        kind = i % 8
        if kind == 0:
            words = [f"{w} |" for w in words]
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        if kind == 2:
            words = [words[0]] * 60
        docs.append((i, " ".join(words), "s", "l", "t", "v"))
        labels.append((i, int(kind > 2), 0))
    docs += [(None, docs[3][1], "s", "l", "t", "v"), (3, docs[3][1], "s", "l", "t", "v"), (3, "| | | a", "s", "l", "t", "v")]
    docs += [(9001, None, "s", "l", "t", "v"), (9002, "", "s", "l", "t", "v"), (9003, docs[3][1] + " x" * 200_000, "s", "l", "t", "v")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, words string, label string, score string, row string")
    return frame, spark.createDataFrame(labels + [(3, 1, 0), (None, 0, 0), (5, None, 0), (6, 9, 0)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, graded):
    docs, labels = graded
    model = quality.learn_quality(docs, labels)
    assert 0 < len(model.weights) < 60
    got = quality.score_quality(docs, model).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(held) > 100
    assert sum(r["predicted"] == int(r["doc_id"] % 8 > 2) for r in held) >= 0.97 * len(held)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    # labels of held-out rows are not read
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.learn_quality(docs, turned) == model


def test_compiled_rules_equal_their_meaning(spark, graded):
    docs, labels = graded
    model = quality.learn_quality(docs, labels)
    rows = quality.with_statistics(docs.select("doc_id", "text").where("doc_id is not null"), "text").collect()
    scores = {}
    for r in quality.score_quality(docs, model).collect():
        scores.setdefault(r["doc_id"], set()).add(r["score"])
    for r in rows:
        line = model.intercept + sum(w for rule, w in model.weights.items() if all((r[n] > b) == above for n, b, above in rule))
        assert any(s == pytest.approx(1 / (1 + math.exp(-line))) for s in scores[r["doc_id"]])


def test_statistics_of_a_text(spark):
    text = "Ab cd, ab 12\n\nAb cd! |"
    row = quality.with_statistics(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "text").orderBy("id").collect()
    assert tuple(quality.STATISTICS) == tuple(row[0].asDict())[1:]
    got = row[0].asDict()
    assert got["log_words"] == pytest.approx(math.log1p(7)) and got["distinct_words"] == pytest.approx(6 / 7)
    assert got["capitals"] == pytest.approx(2 / 10) and got["digits"] == pytest.approx(2 / len(text)) and got["bars"] == pytest.approx(1 / 7)
    assert got["symbols"] == pytest.approx(1 / 7) and got["marks"] == pytest.approx(2 / 7) and got["log_lines"] == pytest.approx(math.log1p(2))
    assert all(value == 0 for name, value in row[1].asDict().items() if name != "id")


def test_quality_without_both_classes(spark, graded):
    docs, labels = graded
    for kept, bounds in ((labels.limit(0), (0.5, 0.5)), (labels.where("quality = 1"), (0.99, 1)), (labels.where("quality = 0"), (0, 0.01))):
        scores = [r["score"] for r in quality.score_quality(docs, quality.learn_quality(docs, kept)).collect()]
        assert bounds[0] <= min(scores) <= max(scores) <= bounds[1]
    assert quality.score_quality(docs.limit(0), quality.learn_quality(docs.limit(0), labels)).collect() == []


def test_lasso_reaches_its_minimum():
    """No small change of any weight lowers the penalised loss."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2, (40, 6)).astype(float)
    n = rng.integers(1, 9, 40).astype(float)
    good = np.minimum(n, rng.integers(0, 9, 40) * x[:, 0] + rng.integers(0, 2, 40))
    intercept, weights = quality.lasso_logistic(x, good, n, 0.02, rounds=5000, settled=1e-10)

    def loss(b, w):
        line = b + x @ w
        return (n * np.log1p(np.exp(line)) - good * line).sum() / n.sum() + 0.02 * np.abs(w).sum()

    best = loss(intercept, weights)
    assert (weights == 0).any() and (weights != 0).any()
    for j in range(6):
        for step in (-1e-3, 1e-3):
            assert loss(intercept, weights + step * (np.arange(6) == j)) >= best
    assert min(loss(intercept + s, weights) for s in (-1e-3, 1e-3)) >= best


def test_tree_paths_are_conjunctions():
    printed = """DecisionTreeClassificationModel: uid=x
  Tree 0 (weight 1.0):
    If (feature 1 <= 0.5)
     If (feature 1 <= 0.25)
      Predict: 0.0
     Else (feature 1 > 0.25)
      Predict: 1.0
    Else (feature 1 > 0.5)
     Predict: 1.0
"""
    name = quality.STATISTICS[1]
    assert quality.tree_paths(printed) == [
        ((name, 0.5, False),), ((name, 0.25, False),), ((name, 0.25, True), (name, 0.5, False)), ((name, 0.5, True),),
    ]
