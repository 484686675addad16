"""Folds over a document's rows beside its text: rows come to Python as columns, and what folds yield leaves as columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: What folds yield goes on in batches of about so many rows.
ROWS = 10_000


def documents(batch: pa.RecordBatch, fields: tuple[str, ...]) -> Iterator[tuple[int, str, list[dict]]]:
    """Of a batch (key, text, array of structs), one document at a time: its number, its text, and its rows with these fields."""
    size = pc.list_value_length(batch.column(2)).to_pylist()
    flat = batch.column(2).flatten()
    cols = [flat.field(f) for f in fields]
    at = 0
    for i, n in enumerate(size):
        yield i, batch.column(1)[i].as_py(), [dict(zip(fields, r, strict=True)) for r in zip(*(c.slice(at, n).to_pylist() for c in cols), strict=True)]
        at += n


def columns(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> list[pa.Array]:
    """Tuples as columns."""
    return [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)]
