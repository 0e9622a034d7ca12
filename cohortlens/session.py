"""Session settings that the plans in this package are written for."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import SparkSession

# Settings for a large cluster. Shuffles start with many partitions
# and adaptive execution merges small ones, so a partition holds about the advised
# size whatever the input; a join partition that is far above the others is split.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.exchange.reuse": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.filterPushdown.string.startsWith": "true",
}


def build_session(
    name: str, master: str | None = None, settings: Mapping[str, str] | None = None
) -> SparkSession:
    """A session with the settings above, or for a local master with Spark's own defaults.

    ``settings`` go on top in both cases.
    """
    builder = SparkSession.builder.appName(name)
    chosen = dict(settings or {})
    if master:
        builder = builder.master(master)
    if not (master or "").startswith("local"):
        chosen = CLUSTER_SETTINGS | chosen
    for key, value in chosen.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local"):
        ship_package(spark)
    return spark


def zipped_package() -> bytes:
    """This package's modules as a zip that Python can import from."""
    package = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, str(path.relative_to(package.parent)))
    return held.getvalue()


def ship_package(spark: SparkSession) -> str:
    """Give the package to the Python workers of all executors; the path of its zip.

    The study runs without Python workers, the corpus operators need them. ``spark-submit
    --py-files`` does the same.
    """
    from .sources.snapshot import run_folder

    path = f"{run_folder(spark)}/cohortlens.zip"
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(location):
        stream = files.create(location, False)
        stream.write(zipped_package())
        stream.close()
        spark.sparkContext.addPyFile(path)
    return path
