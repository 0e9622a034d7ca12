"""Frozen results with a commit protocol, and scratch data that ends with the run.

A frozen result is a folder::

    <path>/data-<uuid>/part-*.parquet     one folder per write
    <path>/manifest-<number>.json         what that write was: folder, schema, rows

A write is committed by renaming its manifest to the next number. The highest number is
the result. Until the rename a reader sees the older result, whatever happens to the
writer; of two writers at once one fails at the rename. The result before the last one
is kept, because a frame that was read from it may still be in use; older ones go.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFEST = re.compile(r"manifest-(\d{8})\.json")
#: Set to "true" where a ``file:`` folder is a mount that all machines of a cluster share.
SHARED_MOUNT = "spark.cohortlens.sharedMount"
#: How many committed results a folder holds: the last, and the one that it replaced.
KEPT = 2


class SnapshotError(RuntimeError):
    """A frozen result is not there, not whole, or was replaced by another writer."""


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and a function that makes its paths."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    return path_of(path).getFileSystem(spark._jsc.hadoopConfiguration()), path_of


def _commits(spark: SparkSession, path: str) -> dict[int, str]:
    """Committed manifests by number."""
    files, path_of = _files(spark, path)
    if not files.exists(path_of(path)):
        return {}
    names = [status.getPath().getName() for status in files.listStatus(path_of(path))]
    return {int(found[1]): name for name in names if (found := MANIFEST.fullmatch(name))}


def _read_text(spark: SparkSession, path: str) -> str:
    files, path_of = _files(spark, path)
    stream = files.open(path_of(path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _manifest(spark: SparkSession, path: str, name: str) -> dict:
    return json.loads(_read_text(spark, f"{path}/{name}"))


def freeze(df: DataFrame, path: str) -> str:
    """Write a result as parquet, replacing an older one, and return the path.

    If the write fails, the older result stays readable and nothing of the new one is left.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    files, path_of = _files(spark, path)
    folder, waiting = f"data-{uuid.uuid4().hex}", f".waiting-{uuid.uuid4().hex}"
    number = max(_commits(spark, path), default=0) + 1
    try:
        df.write.parquet(f"{path}/{folder}")
        rows = spark.read.parquet(f"{path}/{folder}").count()
        manifest = {"folder": folder, "schema": df.schema.jsonValue(), "rows": rows}
        stream = files.create(path_of(f"{path}/{waiting}"), False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if not files.rename(path_of(f"{path}/{waiting}"), path_of(f"{path}/manifest-{number:08d}.json")):
            raise SnapshotError(f"another writer has committed number {number} of {path}")
    except Exception:
        for left in (folder, waiting):
            files.delete(path_of(f"{path}/{left}"), True)
        raise
    _forget(spark, path, number - KEPT)
    return path


def _forget(spark: SparkSession, path: str, upto: int) -> None:
    """Remove results up to a number; the manifest goes first, so none points nowhere."""
    files, path_of = _files(spark, path)
    for number, name in _commits(spark, path).items():
        if number <= upto:
            folder = _manifest(spark, path, name)["folder"]
            files.delete(path_of(f"{path}/{name}"), False)
            files.delete(path_of(f"{path}/{folder}"), True)


def thaw(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Read a frozen result without touching its source.

    The schema is the one that was written, column metadata included. With ``check`` the
    number of rows is compared with the manifest; parquet footers tell it.
    """
    path = path.rstrip("/")
    commits = _commits(spark, path)
    if not commits:
        raise SnapshotError(f"no frozen result in {path}")
    manifest = _manifest(spark, path, commits[max(commits)])
    folder = f"{path}/{manifest['folder']}"
    files, path_of = _files(spark, path)
    if not files.exists(path_of(folder)):
        raise SnapshotError(f"{folder} is gone")
    schema = StructType.fromJson(manifest["schema"])
    found = spark.read.schema(schema).parquet(folder)
    if check:
        stored = {f.name: f.dataType for f in spark.read.parquet(folder).schema}
        if manifest["rows"] and stored != {f.name: f.dataType for f in _nullable(schema)}:
            raise SnapshotError(f"the files in {folder} have another schema than was frozen")
        if (rows := found.count()) != manifest["rows"]:
            raise SnapshotError(f"{folder} holds {rows} rows of {manifest['rows']}")
    return found


def _nullable(schema: StructType) -> StructType:
    """The schema as files give it back, where every part may be NULL."""
    relaxed = json.loads(json.dumps(schema.jsonValue()).replace('"nullable": false', '"nullable": true'))
    text = json.dumps(relaxed).replace('"containsNull": false', '"containsNull": true')
    return StructType.fromJson(json.loads(text.replace('"valueContainsNull": false', '"valueContainsNull": true')))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it; where that is unset, the warehouse serves. A
    folder on the disk of one machine is refused, whichever setting names it, unless the
    session runs on one machine too or ``SHARED_MOUNT`` says that the disk is shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    one_machine = spark.sparkContext.master.startswith("local")
    mounted = spark.conf.get(SHARED_MOUNT, "false") == "true"
    on_disk = folder.startswith("file:") or "://" not in folder and not named
    if on_disk and not one_machine and not mounted:
        raise ValueError(f"{folder} is a folder of one machine: set spark.checkpoint.dir to one that all executors share")
    return folder


def run_folder(spark: SparkSession) -> str:
    """The folder of this run's scratch data; it is removed when the driver ends."""
    folder = f"{shared_folder(spark)}/run-{spark.sparkContext.applicationId}"
    files, path_of = _files(spark, folder)
    if not files.exists(path_of(folder)):
        files.mkdirs(path_of(folder))
        files.deleteOnExit(path_of(folder))
    return folder


def clear_run(spark: SparkSession) -> None:
    """Remove this run's scratch data now; frames that were read from it end here."""
    folder = f"{shared_folder(spark)}/run-{spark.sparkContext.applicationId}"
    files, path_of = _files(spark, folder)
    files.delete(path_of(folder), True)


def snapshot_folder(spark: SparkSession, label: str = "snapshot") -> str:
    """A new, unused folder name among the run's scratch data."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, label: str = "scratch") -> DataFrame:
    """The same rows, written to the shared folder and read again.

    Lineage ends here: a lost executor repeats reads, not what came before. The files go
    when the driver ends.
    """
    path = snapshot_folder(df.sparkSession, label)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.scratch_folder = path
    return found


def discard(*frames: DataFrame | None) -> None:
    """Remove the files of frames that ``scratch`` returned; nothing may read them later.

    Only the very frames are meant: one that was derived from them is refused.
    """
    for df in frames:
        if df is not None:
            files, path_of = _files(df.sparkSession, df.scratch_folder)
            files.delete(path_of(df.scratch_folder), True)
