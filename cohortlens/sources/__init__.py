"""Where tables come from and where results are kept."""

from .jdbc import jdbc_options, jdbc_predicates, read_jdbc_tables
from .parquet import load_tables
from .snapshot import SnapshotError, clear_run, discard, freeze, scratch, snapshot_folder, thaw
from .standin import standin_tables

__all__ = [
    "SnapshotError",
    "clear_run",
    "discard",
    "freeze",
    "jdbc_options",
    "jdbc_predicates",
    "load_tables",
    "read_jdbc_tables",
    "scratch",
    "snapshot_folder",
    "standin_tables",
    "thaw",
]
