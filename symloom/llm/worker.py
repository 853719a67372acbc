"""Memory of Python workers, which Spark keeps from one operator to the next.

A worker keeps one prepared object at a time, rows are taken in blocks of
bounded bytes, and what a task has freed goes back to the system at its end.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows of an Arrow batch: with texts of a few kB, a few MB in the JVM and in the worker.
BATCH_ROWS = 1000
#: Bytes of text that an operator takes apart into words at a time, unless one text is longer.
TEXT_BYTES = 1 << 20

_HELD: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """The object made for ``key``; that of another key goes first."""
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, with freed memory given back after the last."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return whole


def rows_of(batches: Iterator[pa.RecordBatch], at_once: int = 256) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) in lists of at most ``at_once`` rows and about ``TEXT_BYTES``; nulls are empty texts."""
    for batch in batches:
        for first, n in blocks(batch.column(1), at_once):
            part = batch.slice(first, n)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def blocks(texts: pa.Array, at_once: int = 256) -> Iterator[tuple[int, int]]:
    """(first, rows) of blocks of rows, by count and bytes."""
    sizes = [n or 0 for n in pc.binary_length(texts).to_pylist()]
    first, total = 0, 0
    for k, size in enumerate(sizes):
        if k > first and (k - first == at_once or total + size > TEXT_BYTES):
            yield first, k - first
            first, total = k, 0
        total += size
    if len(sizes) > first:
        yield first, len(sizes) - first


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches of this session have ``rows`` rows at most; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
