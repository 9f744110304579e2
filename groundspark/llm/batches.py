"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


#: Bytes of text that a task turns into Python objects at once, about.
PART_BYTES = 4 << 20


def parts(batches: Iterator[pa.RecordBatch], name: str, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches, each with ``limit`` bytes of a string column at most (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_pylist()
        for start, stop in slices([n + 64 for n in sizes], limit):
            yield batch.slice(start, stop - start)
        if not batch.num_rows:
            yield batch


def gathered(batches: Iterator[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold ``limit`` bytes of a string column."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += pc.sum(pc.binary_length(column(batch, name))).as_py() or 0
        if total >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have the session hand texts to Python in smaller Arrow batches, if it doesn't.

    A batch is held by the JVM outside its heap and by the worker, for each Python step of each task at once.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a run of items into consecutive slices whose sizes sum to ``limit`` at most (one item at least)."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
