"""Corpus preparation in five stages; each works on all that the one before kept.

Between stages documents are written as Parquet to the shared checkpoint folder and read again, so a lost
executor never costs more than a stage's own tasks. A folder goes when the next stage is written.

All stages take null ids, languages and texts, empty and very long texts, ties, repeated rows and ids, empty tables and any further
columns, whatever their names: these come back as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm import bpe, decontam, langid, linededup, queries, simhash
from groundspark.runtime import ensure_checkpoint_dir, table

#: Least score that a language needs, and the vocabulary of the last stage.
MIN_LANGUAGE_SCORE = 0.5
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def beside(docs: DataFrame, used: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` applied to ``docs`` with all columns but ``used`` under names that clash with nothing; theirs again after it."""
    aside = {c: c if c in used else f"_held_{k}" for k, c in enumerate(docs.columns)}
    made = stage(docs.select(*[F.col(f"`{c}`").alias(name) for c, name in aside.items()]))
    return made.select(*[F.col(name).alias(c) for c, name in aside.items()])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is uncertain.

    Learns from the documents' own languages, outside the held-out fold. Where there is nothing to
    learn from, nothing is rejected; else null and empty texts go. Repeated rows share their fate.
    """
    model = langid.train(docs.where(queries.learnable("doc_id")))
    if not model.langs:
        return docs
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return beside(docs, ["text"], lambda d: langid.predict(d, model).where(sure))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; a column ``n_chars`` follows.

    Null texts stay null and empty ones empty. Rows that repeat an id count once and lose the same lines; rows with a null id stay as they are.
    """
    used = ["doc_id", "text"]
    if dict(docs.dtypes).get("n_chars") not in ("int", "bigint"):
        return beside(docs, used, linededup.drop_repeated_lines)
    kind = docs.schema["n_chars"].dataType
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return beside(docs, [*used, "n_chars"], lambda d: linededup.drop_repeated_lines(d).withColumn("n_chars", changed))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group: the one with the smallest id, of rows that share it the one with the least text digest.

    Rows with a null id stay, whatever they are near to. Of rows that repeat an id and a text one stays. Null and blank texts are one
    group, as their fingerprint is zero. The values of ``op3`` count here (three words, three bits).
    """
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    own = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), digest.alias("digest")))
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], own.alias("_own_key"))
    found = simhash.near_duplicates(keyed, "_own_key", "text").where(F.col("_own_key").isNotNull())
    dropped = found.where(F.col("_own_key") != F.col("component_id")).select("_own_key").distinct()
    kept = keyed.join(dropped, "_own_key", "left_anti")
    repeated = found.where(F.col("_own_key") == F.col("component_id")).groupBy("_own_key").count().where("count > 1").select("_own_key")
    if not repeated.isEmpty():
        once = kept.join(repeated, "_own_key", "left_semi").dropDuplicates(["_own_key"])
        kept = kept.join(repeated, "_own_key", "left_anti").unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more is in benchmark windows.

    Null and empty texts have no words and stay; repeated rows share their fate.
    """
    benchmark = table(spark, sf_dir, "benchmark")
    return beside(docs, ["text"], lambda d: decontam.decontaminate(d, benchmark).where(~F.col("contaminated")))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, with the digests that ``op9`` returns.

    A row for each row; null and empty texts have no token. Other columns end here.
    """
    path = public_tokenizers.path(VOCABULARY)
    return queries.token_digests(bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id"], bytes_col="decoded"), "tokens")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

#: SQL can't express the learned model, the fingerprints or the encoding; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, done = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = f"{folder}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if done is not None:
            delete(spark, done)
        done = path
    return docs


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder on any file system that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
