"""The pipeline's stages and its run on a small table with null, repeated and shared ids."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from cohortlens.llm import common, jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed, n=40):
    draw = np.random.default_rng(seed)
    return " ".join(draw.choice(WORDS) + str(draw.integers(40)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


A, B, C, D = (prose(seed) for seed in range(4))


def test_near_duplicates_keep_every_text_once(spark):
    near = " ".join(A.split()[:-1] + ["changed"])
    rows = [(1, A), (2, A), (2, B), (3, C), (3, C), (None, A), (None, A), (None, D), (None, D), (5, near), (0, near)]
    rows += [(7, None), (7, None), (8, ""), (8, ""), (None, " "), (9, "one two"), (10, "ONE two")]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = [(0, near), (2, B), (3, C), (None, D), (7, None), (7, None), (8, ""), (8, ""), (None, " "), (9, "one two")]
    assert kept(got) == sorted(want, key=repr)
    assert corpus_pipeline.near_duplicates(spark, frame(spark, []), "").collect() == []


def test_near_duplicates_with_clashing_columns_and_one_hot_row(spark):
    rows = [(i, A, "x", "y", 1) for i in range(3)] + [(9, B, "x", "y", 1)] * 2000 + [(10, C, "x", "y", 2), (10, C, "x", "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string, component_id string, n int")
    got = jaccard.one_per_component(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted([(0, A), (9, B), (10, C)])


def test_row_keys_tell_rows_apart(spark):
    rows = [(None, "a"), ("a", None), ("a", "a"), (None, None), ("", "a"), ("a", "")]
    docs = spark.createDataFrame(rows, "x string, y string")
    assert docs.select(common.row_key(docs.columns)).distinct().count() == len(rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark as parquet: toxic texts, copies and leaks among clean ones."""
    root = str(tmp_path_factory.mktemp("tables"))
    item = "Anna has 12 red apples and gives 5 of them to her brother Ben before the long walk home. How many apples does Anna have left?"
    rows, labels = [], []
    for i in range(300):
        text = prose(100 + i)
        if bad := i % 5 == 0:
            text += f" idiot scoundrel worthless {prose(i, 5)}"
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + i, rows[1][1]) for i in range(40)]
    rows += [(2000, f"{prose(7)} {item} {prose(8)}"), (None, f"{prose(9)} {item}"), (2, f"{prose(11)} {item} {prose(12)}")]
    rows += [(None, prose(13)), (4000, ""), (4001, None)]
    frame(spark, rows).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, item


def test_stages_against_brute_force(spark, folder):
    root, rows, item = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    left = [(i, t) for i, t in rows if "idiot" not in (t or "")]
    found = corpus_pipeline.toxicity(spark, docs, root)
    assert found.columns == docs.columns and kept(found) == sorted(left, key=repr)
    # copies of row 1 have larger ids
    left = [(i, t) for i, t in left if not (i or 0) in range(1000, 1040)]
    found = corpus_pipeline.near_duplicates(spark, common.written(found, "t"), root)
    assert found.columns == docs.columns and kept(found) == sorted(left, key=repr)
    # rows without an id that hold the item go too; other rows of an id that holds it stay
    left = [(i, t) for i, t in left if item not in (t or "")]
    found = corpus_pipeline.decontamination(spark, common.written(found, "t"), root)
    assert found.columns == docs.columns and kept(found) == sorted(left, key=repr)
    assert (2, rows[2][1]) in left and (None, prose(13)) in left
    mixed = corpus_pipeline.mixing(spark, common.written(found, "t"), root)
    assert mixed.columns == docs.columns
    drawn = kept(mixed)
    assert 0.35 * len(left) <= len(drawn) <= 0.65 * len(left) and set(drawn) <= set(left)
    sharded = corpus_pipeline.sharding(spark, common.written(mixed, "t"), root)
    assert sorted((r["doc_id"] for r in sharded.collect()), key=str) == sorted((i for i, _ in drawn), key=str)
    # the whole run is its stages
    whole = corpus_pipeline.run(spark, root)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, sharded.collect()))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_stages_of_nothing(spark, folder):
    root, _, _ = folder
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, root).collect() == []


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [name for name in ("ArrowEvalPython", "MapInArrow", "BatchEvalPython", "MapInPandas") if name in plan]


def test_rows_are_left_out_without_python(spark, folder):
    root, rows, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert python_nodes(corpus_pipeline.decontamination(spark, docs, root)) == []
    ids = spark.createDataFrame([(1,), (5,), (None,)], "doc_id long")
    assert python_nodes(common.one_of_each(docs, ids, ids.where("false"), "doc_id")) == []


def test_sharding_evaluates_python_once_for_each_scan(spark, folder):
    root, _, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    plan = corpus_pipeline.sharding(spark, docs, root)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == plan.count("FileScan") == 2


@pytest.mark.parametrize("most_bits", [common.MOST_BITS, 64])
def test_marks_and_what_is_left(spark, monkeypatch, most_bits):
    # with 64 bits most other keys pass, so the exact joins have to sort them out
    monkeypatch.setattr(common.marked, "__defaults__", (most_bits,))
    large = 1 << 62
    keys = [-large, -64, -1, 0, 1, 63, 64, large + 5]
    docs = frame(spark, [(i, str(i)) for i in [*range(-200, 200), large, large + 5, -large]] + [(None, "x"), (None, "x"), (7, "7")])
    ids = spark.createDataFrame([(i,) for i in [*keys, None, 63]], "doc_id long")
    marks = common.marked(docs, "doc_id", ids, "doc_id")
    assert marks.columns == [*docs.columns, "_maybe"]
    got = [(r["doc_id"], r["_maybe"]) for r in marks.collect()]
    assert len(got) == docs.count() and {i for i, maybe in got if maybe} >= set(keys)
    assert all(maybe is False for i, maybe in got if i is None)
    want = sorted((r for r in kept(docs) if r[0] not in keys), key=repr)
    assert kept(common.without_ids(docs, ids)) == want
    seven = spark.createDataFrame([(7,)], "doc_id long")
    want.remove((7, "7"))
    assert kept(common.one_of_each(docs, ids, seven, "doc_id")) == want
