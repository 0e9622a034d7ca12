"""The corpus pipeline: toxic texts and copies go, leaks go, sources are mixed, rows are sharded.

Each stage takes the documents that the one before has kept. ``run`` writes them as
parquet below the shared folder and reads them again, so a lost executor repeats tasks
of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm.common import row_key, without_ids, written
from cohortlens.llm.jaccard import one_per_component
from cohortlens.llm.mixing import keep_mixed
from cohortlens.llm.shards import assign_shards
from cohortlens.llm.templates import contaminated
from cohortlens.llm.toxicity import drop_toxic, learn_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose learned score reaches 0.5 go."""
    return drop_toxic(docs, learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the smallest id, rows without one last.

    Rows are told apart by all their columns, so different texts under one id are
    different documents and a row that is there twice is a copy of itself. Rows
    without words are in no group and stay.
    """
    return one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, whatever their id, and no others."""
    keyed = docs.withColumn("_row", row_key(docs.columns))
    texts = keyed.select(F.col("_row").alias("doc_id"), "text")
    found = contaminated(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without_ids(keyed, written(found.select("doc_id").distinct(), "leaks"), "_row").drop("_row")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities that mix sources, languages and topics."""
    return keep_mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return assign_shards(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Learned scores, hashed draws and jump hashes have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
