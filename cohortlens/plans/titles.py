"""Titles of a table and its columns, carried as column metadata.

Parquet keeps column metadata, so a table that is written and read again still knows
what it is called. What belongs to the whole table is kept with its first column.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

LABEL, TITLE, NOTE = "label", "table_title", "table_note"


@dataclass(frozen=True)
class Titles:
    """What is printed around the cells."""

    title: str | None = None
    note: str | None = None
    labels: dict[str, str] = field(default_factory=dict)


def titled(
    df: DataFrame, labels: Mapping[str, str], title: str | None = None, note: str | None = None
) -> DataFrame:
    """Attach column labels, a title and a note; older ones stay where none is given."""
    old = titles_of(df)
    labels = old.labels | dict(labels)
    whole = {TITLE: title or old.title, NOTE: note or old.note}
    columns = []
    for place, name in enumerate(df.columns):
        metadata = {LABEL: labels[name]} if name in labels else {}
        if place == 0:
            metadata |= {key: text for key, text in whole.items() if text}
        columns.append(F.col(name).alias(name, metadata=metadata) if metadata else F.col(name))
    return df.select(*columns)


def titles_of(df: DataFrame) -> Titles:
    """Titles of a table, as far as it has any."""
    found = {f.name: f.metadata or {} for f in df.schema.fields}
    first = next(iter(found.values()), {})
    labels = {name: metadata[LABEL] for name, metadata in found.items() if LABEL in metadata}
    return Titles(first.get(TITLE), first.get(NOTE), labels)
