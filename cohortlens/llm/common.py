"""What several operators share: held-out rows, written tables, bit filters."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import scratch

#: Bits of a bit filter at most: 4 MB, whatever the number of keys.
MOST_BITS = 1 << 25
#: Rows in a batch between Spark and Python, and bytes where rows are wide.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
BYTES_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; a missing id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 5 == 0


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python ``BATCH_ROWS`` or ``BATCH_BYTES`` at a time in this session, if more are set.

    Both sides hold a batch whole, in memory that they are slow to give back, and texts
    are wide rows. A row that is longer is a batch of its own.
    """
    if int(spark.conf.get(BATCH_SETTING)) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    now = spark.conf.get(BYTES_SETTING).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(BYTES_SETTING, str(BATCH_BYTES))


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends here."""
    small_batches(df.sparkSession)
    return scratch(df, label)


def free_shuffles(spark: SparkSession) -> None:
    """Remove the shuffle files of finished steps that nothing refers to any more.

    Spark removes them when the driver collects its garbage, which a driver with little
    to do may put off until the disks hold the shuffles of all steps. Call it only where
    large shuffles lie behind: it takes the driver some tenths of a second.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _bits_of(keys: DataFrame, column: str, most_bits: int) -> tuple[DataFrame, int]:
    """``word, bits``: a bitmap with the low bits of every key set, and its size in bits."""
    n = keys.count()
    bits = min(most_bits, max(1 << 16, 1 << (8 * n).bit_length()))
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = (
        keys.where(F.col(column).isNotNull())
        .select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    )
    return words, bits


def bit_filter(keys: DataFrame, column: str, most_bits: int = MOST_BITS) -> np.ndarray:
    """A bitmap with the low bits of every key set; its size is bounded.

    A filter may let other keys pass, so what it lets pass is joined exactly
    afterwards. Bits are merged in Spark; the driver gets at most
    ``most_bits / 64`` words.
    """
    found, bits = _bits_of(keys, column, most_bits)
    words = found.toArrow()
    bitmap = np.zeros(bits // 64, dtype=np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bitmap


def marked(rows: DataFrame, column: str, keys: DataFrame, key: str, most_bits: int = MOST_BITS) -> DataFrame:
    """``rows`` with ``_maybe``: whether a bit filter of the keys lets the row's ``column`` pass.

    The filter as a join with its words (16 MB or so at most), which are broadcast: no
    row moves and no row goes to Python. A null passes no filter.
    """
    words, bits = _bits_of(keys, key, most_bits)
    place = F.col(column).cast("long").bitwiseAND(F.lit(bits - 1))
    words = F.broadcast(words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    wide = rows.join(words, F.shiftright(place, 6) == F.col("_word"), "left")
    bit = F.getbit("_bits", place.bitwiseAND(F.lit(63)).cast("int"))
    return wide.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(bit == 1, F.lit(False)).alias("_maybe"))


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys the filter lets pass."""
    place = keys.view(np.uint64) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def shared(spark: SparkSession, value):
    """Broadcast a value whose size the caller has bounded."""
    small_batches(spark)
    return spark.sparkContext.broadcast(value)


def row_key(columns: list[str]) -> Column:
    """A 64-bit hash of a whole row; rows with the same key are the same row."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of splitmix64, a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def without_ids(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids`` (one column ``doc_id``).

    Only rows that a bit filter of the ids lets pass are shuffled for the exact join;
    all others are kept where they are. Rows without an id are kept.
    """
    rows = marked(docs, doc_id, ids, "doc_id")
    suspects = rows.where("_maybe").drop("_maybe").alias("d").join(ids.alias("gone"), F.col(f"d.{doc_id}") == F.col("gone.doc_id"), "left_anti")
    return rows.where("not _maybe").drop("_maybe").union(suspects)


def one_of_each(docs: DataFrame, gone: DataFrame, repeated: DataFrame, key: str) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``gone``, and once those in ``repeated``.

    ``gone`` and ``repeated`` have one column, ``key``; no key is in both. All rows of a
    repeated key are the same row. Only rows that a bit filter lets pass are shuffled.
    """
    rows = marked(docs, key, gone.union(repeated), key)
    suspects = rows.where("_maybe").drop("_maybe")
    wide = suspects.join(repeated.withColumnRenamed(key, "_once"), F.col(key) == F.col("_once"), "left")
    wide = wide.join(gone.withColumnRenamed(key, "_gone"), F.col(key) == F.col("_gone"), "left").where("_gone is null")
    many = wide.where("_once is null").select(*docs.columns)
    once = wide.where("_once is not null").select(*docs.columns).dropDuplicates([key])
    return rows.where("not _maybe").drop("_maybe").union(many).union(once)
