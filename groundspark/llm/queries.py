"""The registered queries: each applies its operator to whole tables and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm import ann, bpe, decontam, filteraudit, importance, langid, linededup, minhash, quality, secrets, sharding, simhash, urlfilter
from groundspark.runtime import spread, table

#: Fixed values of the contract: URL rules as (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
HELD_OUT_FOLDS = 5


def _fold(id_col: str | Column) -> Column:
    text = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % HELD_OUT_FOLDS, F.lit(-1))


def learnable(id_col: str | Column) -> Column:
    """Rows outside the held-out fold; not those with a null id."""
    return _fold(id_col) > 0


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For operators that work long on each text."""
    return spread(table(spark, sf_dir, "documents"))


def _hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with a null id are neither learned from nor held out."""
    docs = _documents(spark, sf_dir)
    model = langid.train(docs.where(learnable("doc_id")))
    scored = langid.predict(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (_fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), train_on=learnable)
    return scored.select("doc_id", (_fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.drop_repeated_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", _hex(F.col("text")).alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), _hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def token_digests(decoded: DataFrame, *more: str) -> DataFrame:
    """Counts and digests of columns ``tokens`` and ``decoded``."""
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), _hex(ids).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_digests(bpe.encode(_documents(spark, sf_dir), path, public_tokenizers.PATTERN, keep=["doc_id"], bytes_col="decoded"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf_dir))
    kinds = F.array(*[F.lit(r.kind) for r in secrets.RULES])
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{secrets.RULES[k].kind}")
    return found.select("doc_id", *map(of_kind, range(3)), shown.alias("spans")).withColumn("base_sha256", _hex(F.col("spans")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_nearest_neighbours, op3_simhash, op4_quality, op5_sharding, op6_line_dedup, op7_url_filter, op8_decontamination, op9_byte_bpe, op10_secret_scan,
        op11_filter_audit, op12_importance, op13_minhash,
    )
}
