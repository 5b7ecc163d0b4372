"""Arrow helpers for operators that work on texts in Python tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that a task holds as Python objects at a time.
ROWS = 512


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it


def give_back() -> None:
    """Return the worker's free memory to the machine, once a task: workers live on and would keep the most that any task took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def byte_texts(batches: Iterator[pa.RecordBatch], text: int = 1, rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of at most ``rows`` rows with the texts in column ``text`` as UTF-8 (null: empty)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, [x or b"" for x in part.column(text).cast(pa.binary()).to_pylist()]
    give_back()


def texts(batches: Iterator[pa.RecordBatch], text: int = 1, rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The same as strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, [x or "" for x in part.column(text).to_pylist()]
    give_back()


def bucket(column: Column | str, of: int) -> Column:
    """crc32 of the column as text, modulo ``of``."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % of
