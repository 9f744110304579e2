"""Questions with known entities from JSON, and results of an evaluation as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = "id string, query string, type string, ground_truth_entities array<string>, ground_truth_claim string"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, query_id, query, kind, truth, claim)`` of files that each hold a JSON array of questions.

    ``query_id`` is a hash of the id; missing entities are an empty list; entries without a question are left out.
    """
    rows = spark.read.schema(_FIELDS).option("multiLine", "true").json(path).where("query is not null")
    return rows.select(
        F.col("id").alias("sample_id"), F.xxhash64("id").alias("query_id"), "query", F.col("type").alias("kind"),
        F.coalesce("ground_truth_entities", F.expr("cast(array() as array<string>)")).alias("truth"), F.col("ground_truth_claim").alias("claim"),
    )


def write_report(report: DataFrame, path: str) -> None:
    """A row a line of JSON, nulls included, in place of what was there."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
