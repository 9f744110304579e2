"""Questions as a stream: answers' events for every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def question_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream of ``(query_id, query)`` from new JSON files, one question a line."""
    return spark.readStream.schema("query_id string, query string").json(path).where("query_id is not null and query is not null")


def answer_stream(stream: DataFrame, events: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Write ``events`` (for instance ``Engine.answer_events``) of every micro-batch under ``out``, then stop when no questions are left.

    A batch has a folder of its own (column ``batch`` when the whole is read), which a repeated batch replaces, so every event is there once.
    """

    def each(questions: DataFrame, number: int) -> None:
        events(questions.dropDuplicates(["query_id"])).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
