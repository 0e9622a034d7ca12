"""What the near-duplicate join leaves on disk and holds there at once."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import jaccard
from cohortlens.llm.components import components
from cohortlens.llm.shingles import shingle_sets
from cohortlens.sources import discard, scratch
from cohortlens.sources.snapshot import run_folder


def prose(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join(f"word{draw.integers(4000)}" for _ in range(n))


def near_copies():
    """Twelve groups of five near copies, three sets of them under two ids each."""
    rows = []
    for group in range(12):
        words = prose(group, 300).split()
        for copy in range(5):
            rows.append((10 * group + copy, " ".join([*words[: 290 - copy], f"end{group}", f"copy{copy}"])))
    return rows + [(1000 + i, rows[20 * i][1]) for i in range(3)]


def tables(spark):
    return sorted(p.name.rpartition("-")[0] for p in Path(run_folder(spark).removeprefix("file:")).iterdir() if p.is_dir())


def test_tables_of_finished_steps_go(spark):
    before = tables(spark)
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string")
    found = jaccard.near_duplicate_components(docs)
    left = tables(spark)
    for name in before:
        left.remove(name)
    assert sorted(left) == ["nodes", "sets"]  # what the result is read from
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert got == {i: (0, 40, 80)[i - 1000] if i >= 1000 else i - i % 10 for i in got} and len(got) == 63


def test_texts_are_kept_for_verification_and_not_their_hashes(spark, monkeypatch):
    held = {}

    def sized(df, label, put=jaccard.written):
        out = put(df, label)
        folder = Path(out.scratch_folder.removeprefix("file:"))
        held[label] = max(held.get(label, 0), sum(p.stat().st_size for p in folder.glob("*.parquet")))
        return out

    monkeypatch.setattr(jaccard, "written", sized)
    rows = near_copies()
    jaccard.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert max(held.values()) < 0.85 * sum(len(text) for _, text in rows)


def test_pairs_of_texts_become_pairs_of_token_lists():
    left, right = ["a b c d e f", "a b c d e f", "x", "a b c d e f"], ["b c d e f g", "é ü", "", "A B C D E F"]
    batch = pa.RecordBatch.from_pydict({"a": [1, 1, 2, 1], "b": [5, 6, 7, 8], "left": left, "right": right})
    rows = [r for out in jaccard._tokens_of_pairs(5, iter)(iter([batch, batch.slice(0, 0)])) for r in out.to_pylist()]
    assert [(r["a"], r["b"]) for r in rows] == [(1, 5), (1, 6), (2, 7), (1, 8)]
    for name, texts in (("left", left), ("right", right)):
        assert [r[name] for r in rows] == [s.tobytes() for s in shingle_sets(pa.array(texts), 5)]


def test_components_leave_one_table(spark):
    before = tables(spark)
    placed = components(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40)], "a long, b long"))
    left = tables(spark)
    for name in before:
        left.remove(name)
    assert left == ["nodes"]
    assert {r["root"] for r in placed.collect()} == {0, 40}


def test_only_scratch_frames_are_discarded(spark):
    kept = scratch(spark.range(5), "few")
    with pytest.raises(AttributeError):
        discard(kept.where("id > 2"))
    assert kept.count() == 5
    discard(kept, None)
    assert not Path(kept.scratch_folder.removeprefix("file:")).exists()
