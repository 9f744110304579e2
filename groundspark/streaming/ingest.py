"""Incremental ingest: a file stream, deduplicated by checksum, processed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream of ``(path, content, title, checksum_sha256)`` of new files.

    Equal contents are told apart by the sink, which knows the checksums of all that was ingested, so the stream keeps no state.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(path)
    return files.select("path", "content", F.lit(None).cast("string").alias("title"), F.sha2("content", 256).alias("checksum_sha256"))


def ingest_stream(stream: DataFrame, sink: Callable[[DataFrame, tuple[str, int]], object], checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Hand every micro-batch to ``sink`` (for instance ``Engine.ingest``) with the writer's name and the batch's number, then stop when no files are left.

    After a restart from ``checkpoint`` finished files aren't read again. A batch that a failure repeats has the number it had, so a sink that
    commits the number with the rows, as the engine does, has each batch once. The name is the checkpoint's folder unless one is given.
    """
    writer = name or checkpoint.rstrip("/")
    each = lambda df, number: sink(df, (writer, number)) and None
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
