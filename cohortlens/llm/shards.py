"""Sharding by jump consistent hashing: no ring table, appending a shard moves rows only into it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import mixed

#: Parts in which the rows of a shard are numbered; their counts are the only thing broadcast.
BUCKETS = 1024
#: Rows that are listed at a time where a row occurs many times.
STRIDE = 4096
NO_ID = -(1 << 63)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, by the published jump consistent hash."""
    key = mixed(keys.astype(np.int64).view(np.uint64))
    shard = np.full(len(key), -1, dtype=np.int64)
    ahead = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (key[live] >> np.uint64(33)).astype(np.float64) + 1
        ahead[live] = ((shard[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def shard_of(column, shards: int):
    """Column with the shard of an id; rows without an id share one shard."""

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        return pa.array(jump(ids.to_numpy(zero_copy_only=False), shards).astype(np.int32))

    return place(F.coalesce(column.cast("long"), F.lit(NO_ID)))


def _placed(shards: int):
    """Adds ``shard`` and ``grown_shard``, the place with one shard more.

    Not as Arrow functions: the join below asks for shards that are not null, and for that
    filter Spark would work them out once more, in a second worker beside the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)
            found = [pa.array(jump(keys, n).astype(np.int32)) for n in (shards, shards + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "shard", "grown_shard"])

    return run


def assign_shards(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row of ``docs``.

    The id and the number of shards decide (law ``key``), so equal ids meet and a
    further shard takes rows only into itself; ``grown_shard`` is the place with one
    more. ``size``: UTF-8 bytes plus 8; a null text has none and checksum 0. Slots
    count from 0 without gaps by (part, id, checksum, size). The part of a row is a hash
    of id and checksum, so an id with many texts is spread; the parts' counts, at most
    shards * ``BUCKETS`` rows, give where each part starts. Rows that are equal in all
    of this are counted first and numbered together, so repeated rows make no part
    large; each gets a slot. Rows without an id share a shard; other columns are ignored.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    placed = ids.select(
        "doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32")
    )
    placed = placed.mapInArrow(_placed(shards), "doc_id long, size long, text_crc32 long, shard int, grown_shard int")
    counted = placed.groupBy(*placed.columns).agg(F.count("*").alias("n"))
    bucket = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID)), "text_crc32"), F.lit(BUCKETS)).cast("int")
    counted = counted.withColumn("bucket", bucket)
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    earlier = up_to(Window.partitionBy("shard").orderBy("bucket"))
    starts = counted.groupBy("shard", "bucket").agg(F.sum("n").alias("held"))
    starts = starts.select("shard", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    within = up_to(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    numbered = counted.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    joined = numbered.join(F.broadcast(starts), ["shard", "bucket"]).withColumn("first", F.col("start") + F.col("before"))
    # in two steps, so that no list of rows is longer than STRIDE however often a row occurs
    strides = joined.withColumn("stride", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STRIDE).cast("long"))))
    rest = F.least(F.col("n") - F.col("stride"), F.lit(STRIDE).cast("long")) - 1
    each = strides.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), rest)))
    slot = (F.col("first") + F.col("stride") + F.col("offset")).cast("long").alias("slot")
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24, doc_id: str = "doc_id") -> None:
    """The rows of ``docs`` as parquet, one folder per shard; a shard may have several files."""
    name = "shard"
    while name in docs.columns:
        name = "_" + name
    docs.withColumn(name, shard_of(F.col(doc_id), shards)).write.partitionBy(name).parquet(path)
