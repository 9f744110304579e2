"""Claims against evidence: alignment, contradiction, status, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.config import Config
from groundspark.functions.text import NEGATED, claims, numbers, stem_tokens
from groundspark.operators.embedding import dot, embed

# Texts in answers.
UNKNOWN, BADGE_ENTAILED, BADGE_CONTRADICTION = "Unknown Document", " ✓", " ⚠️ [Contradiction Detected]"
ENTAILED, NEUTRAL, CONTRADICTION = "ENTAILED", "NEUTRAL", "CONTRADICTION"
# Reasons and badges of single claims.
REASON_NOTHING = "No context passages available for verification."
REASON_NEUTRAL = "Claim contains facts not fully corroborated by retrieved context."
REASON_POLARITY = "Polarity conflict: claim negates a fact affirmed in the context"
REASON_NUMBERS, REASON_VERSUS = "Numerical discrepancy: Claim cites ", " vs Context "
REASON_ALIGNED, REASON_CHUNK, REASON_COSINE, REASON_RECALL = "Aligned with '", "' (Chunk ", ") [Cosine: ", ", Token Recall: "
CLAIM_CONTRADICTED, CLAIM_VERIFIED, CLAIM_UNVERIFIED = "❌ CONTRADICTION", "✅ Verified [", "⚠️ UNVERIFIED"


def claim_table(answers: DataFrame, id_col: str = "query_id", text_col: str = "answer", cfg: Config = Config(), strict: bool = False) -> DataFrame:
    """``(id_col, claim_ord, claim)``."""
    return answers.select(id_col, F.posexplode(claims(F.col(text_col), cfg.min_claim_words, strict)).alias("claim_ord", "claim"))


def contradicts(claim: Column, context_numbers: Column, shared: Column) -> Column:
    """Numbers on both sides of which none agrees, or a negated claim, with three stems in common."""
    own = numbers(claim)
    clash = (F.size(own) > 0) & (F.size(context_numbers) > 0) & ~F.arrays_overlap(own, context_numbers)
    return (shared >= 3) & (clash | F.lower(claim).rlike(NEGATED))


def align(claim_rows: DataFrame, contexts: DataFrame, cfg: Config = Config(), id_col: str = "query_id", provider: Callable | None = None) -> DataFrame:
    """Each claim with each context of its query: ``shared``, ``recall``, ``cosine``, ``score``, ``contradicts``.

    ``contexts`` has ``rank``, ``chunk_id`` and ``content``. Every distinct text is embedded once; a context
    counts with its first ``context_chars`` characters in the cosine and whole in the recall. Vectors of different spaces (see ``embed``) have the cosine 0.
    """
    claim_rows = claim_rows.select(id_col, "claim_ord", "claim", stem_tokens(F.col("claim")).alias("c_stems"), F.xxhash64("claim").alias("c_key"))
    head = F.substring("content", 1, cfg.context_chars)
    contexts = contexts.select(id_col, "rank", "chunk_id", stem_tokens(F.col("content")).alias("x_stems"), numbers(F.col("content")).alias("x_nums"), head.alias("head"), F.xxhash64(head).alias("x_key"))
    texts = claim_rows.select(F.col("c_key").alias("key"), F.col("claim").alias("text")).unionByName(contexts.select(F.col("x_key").alias("key"), F.col("head").alias("text"))).groupBy("key").agg(F.min("text").alias("text"))
    vectors = embed(texts, cfg.embedding_dim, "key", provider=provider, space="remote")
    left = claim_rows.join(vectors.select(F.col("key").alias("c_key"), F.col("embedding").alias("c_vec"), F.col("space").alias("c_space")), "c_key")
    right = contexts.join(vectors.select(F.col("key").alias("x_key"), F.col("embedding").alias("x_vec"), F.col("space").alias("x_space")), "x_key")
    both = left.join(right, id_col).withColumn("shared", F.size(F.array_intersect("c_stems", "x_stems")))
    recall = F.when(F.size("c_stems") > 0, F.col("shared") / F.size("c_stems")).otherwise(0.0)
    scored = both.withColumn("recall", recall).withColumn("cosine", F.when(F.col("c_space") == F.col("x_space"), dot(F.col("c_vec"), F.col("x_vec"))).otherwise(0.0))
    return scored.withColumn("score", 0.6 * F.col("cosine") + 0.4 * F.col("recall")).withColumn("contradicts", contradicts(F.col("claim"), F.col("x_nums"), F.col("shared"))).select(
        id_col, "claim_ord", "claim", "rank", "chunk_id", "shared", "recall", "cosine", "score", "contradicts"
    )


def best_evidence(aligned: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Best context of each claim: the highest positive score, ties to the better rank. Scores count to ten places, so that what is left of a sum that cancels is zero."""
    known = F.round("score", 10)
    order = Window.partitionBy(id_col, "claim_ord").orderBy(F.desc(known), "rank")
    return aligned.where(known > 0).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def claim_status(claim_rows: DataFrame, aligned: DataFrame, cfg: Config = Config(), id_col: str = "query_id") -> DataFrame:
    """``(id_col, claim_ord, claim, status, confidence, cited_chunk_id)``.

    Any contradicting context wins and is cited by rank; else the best score decides; claims without
    contexts are neutral at 0.1.
    """
    per = aligned.groupBy(id_col, "claim_ord").agg(
        F.bool_or("contradicts").alias("against"), F.min_by("chunk_id", F.when(F.col("contradicts"), F.col("rank"))).alias("against_id"), F.count(F.lit(1)).alias("n")
    )
    best = best_evidence(aligned, id_col).select(id_col, "claim_ord", F.col("score").alias("best"), F.col("chunk_id").alias("best_id"))
    all_rows = claim_rows.select(id_col, "claim_ord", "claim").join(per, [id_col, "claim_ord"], "left").join(best, [id_col, "claim_ord"], "left")
    score = F.coalesce("best", F.lit(0.0))
    status = F.when(F.col("against"), CONTRADICTION).when(score >= cfg.entailment_threshold, ENTAILED).otherwise(NEUTRAL)
    conf = F.when(F.col("n").isNull(), 0.1).when(F.col("against"), 0.88).when(score >= cfg.entailment_threshold, F.round(F.least(score, F.lit(0.99)), 3)).otherwise(F.round(score, 3))
    cited = F.when(F.col("against"), F.col("against_id")).when(score > cfg.cite_threshold, F.col("best_id"))
    return all_rows.select(id_col, "claim_ord", "claim", status.alias("status"), conf.alias("confidence"), cited.alias("cited_chunk_id"))


def explained(verified: DataFrame, aligned: DataFrame, contexts: DataFrame, id_col: str = "query_id") -> DataFrame:
    """``verified`` with ``reasoning`` and ``citation_badge``.

    A contradiction names the numbers that clash (sorted), or the negation, with the first contradicting context; an entailed claim the
    title, the first eight characters of the chunk's id, cosine and recall of its best one.
    """
    told = contexts.select(id_col, "rank", "title", numbers(F.col("content")).alias("x_nums"))
    against = aligned.where("contradicts").groupBy(id_col, "claim_ord").agg(F.min("rank").alias("rank")).join(told, [id_col, "rank"]).select(id_col, "claim_ord", F.col("x_nums").alias("against_nums"))
    best = best_evidence(aligned, id_col).join(told.drop("x_nums"), [id_col, "rank"], "left").select(id_col, "claim_ord", F.col("chunk_id").alias("best_chunk"), "title", "cosine", "recall")
    seen = aligned.groupBy(id_col, "claim_ord").agg(F.count(F.lit(1)).alias("n_contexts"))
    keys = [id_col, "claim_ord"]
    rows = verified.join(against, keys, "left").join(best, keys, "left").join(seen, keys, "left")
    own = numbers(F.col("claim"))
    shown = lambda c: F.concat(F.lit("{"), F.array_join(F.array_sort(c), ", "), F.lit("}"))
    places = lambda c: F.format_string("%.2f", F.bround(c, 2))
    clash = (F.size(own) > 0) & (F.size("against_nums") > 0) & ~F.arrays_overlap(own, "against_nums")
    fact = F.concat(
        F.lit(REASON_ALIGNED), F.coalesce("title", F.lit(UNKNOWN)), F.lit(REASON_CHUNK), F.substring(F.col("best_chunk").cast("string"), 1, 8),
        F.lit(REASON_COSINE), places("cosine"), F.lit(REASON_RECALL), places("recall"), F.lit("]"),
    )
    reason = (
        F.when(F.col("n_contexts").isNull(), REASON_NOTHING)
        .when(F.col("status") == CONTRADICTION, F.when(clash, F.concat(F.lit(REASON_NUMBERS), shown(own), F.lit(REASON_VERSUS), shown(F.col("against_nums")))).otherwise(REASON_POLARITY))
        .when(F.col("status") == ENTAILED, fact)
        .otherwise(REASON_NEUTRAL)
    )
    badge = F.when(F.col("status") == CONTRADICTION, CLAIM_CONTRADICTED).when(F.col("status") == ENTAILED, F.concat(F.lit(CLAIM_VERIFIED), F.coalesce("title", F.lit(UNKNOWN)), F.lit("]"))).otherwise(CLAIM_UNVERIFIED)
    return rows.select(*verified.columns, reason.alias("reasoning"), badge.alias("citation_badge"))


def faithfulness(answers: DataFrame, verified: DataFrame, id_col: str = "query_id") -> DataFrame:
    """``(id_col, faithfulness, n_claims)``: entailed share; answers without claims are faithful."""
    share = verified.groupBy(id_col).agg(F.avg((F.col("status") == ENTAILED).cast("double")).alias("f"), F.count(F.lit(1)).alias("n"))
    return answers.select(id_col).distinct().join(share, id_col, "left").select(id_col, F.round(F.coalesce("f", F.lit(1.0)), 3).alias("faithfulness"), F.coalesce("n", F.lit(0)).alias("n_claims"))


def citation_numbers(verified: DataFrame, id_col: str = "query_id") -> DataFrame:
    """``(id_col, cited_chunk_id, number)``: chunks numbered by their first citing claim."""
    first = verified.where("cited_chunk_id is not null").groupBy(id_col, "cited_chunk_id").agg(F.min("claim_ord").alias("first"))
    return first.select(id_col, "cited_chunk_id", F.row_number().over(Window.partitionBy(id_col).orderBy("first")).alias("number"))


def source_records(numbered: DataFrame, contexts: DataFrame, id_col: str = "query_id") -> DataFrame:
    """A record for each citation number; chunks that aren't among the contexts have an unknown document."""
    known = contexts.select(id_col, F.col("chunk_id").alias("cited_chunk_id"), "title", F.array_join("breadcrumbs", " > ").alias("crumbs"), F.concat(F.substring("content", 1, 200), F.lit("...")).alias("excerpt"))
    joined = numbered.join(known, [id_col, "cited_chunk_id"], "left")
    return joined.select(id_col, "number", "cited_chunk_id", F.coalesce("title", F.lit(UNKNOWN)).alias("document_title"), F.coalesce("crumbs", F.lit("")).alias("breadcrumbs"), F.coalesce("excerpt", F.lit("")).alias("excerpt"))


def attributed_answer(answers: DataFrame, verified: DataFrame, id_col: str = "query_id") -> DataFrame:
    """``(id_col, response)``: claims with citation numbers and badges, joined by spaces; without claims empty."""
    marked = verified.join(citation_numbers(verified, id_col), [id_col, "cited_chunk_id"], "left")
    badge = F.when(F.col("status") == ENTAILED, BADGE_ENTAILED).when(F.col("status") == CONTRADICTION, BADGE_CONTRADICTION).otherwise("")
    shown = F.concat("claim", F.coalesce(F.concat(F.lit(" ["), F.col("number").cast("string"), F.lit("]")), F.lit("")), badge)
    parts = marked.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("claim_ord", shown.alias("s")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["s"]), " ")
    return answers.select(id_col).distinct().join(parts, id_col, "left").select(id_col, F.coalesce(text, F.lit("")).alias("response"))


def relevance(answers: DataFrame, cfg: Config = Config(), id_col: str = "query_id", query_col: str = "query", text_col: str = "answer", provider: Callable | None = None) -> DataFrame:
    """``(id_col, relevance)``: cosine of query and answer's head moved to 0..1."""
    head = F.substring(text_col, 1, cfg.context_chars)
    made = lambda text: embed(answers.select(id_col, text.alias("text")), cfg.embedding_dim, id_col, provider=provider, space="remote")
    q = made(F.col(query_col)).select(id_col, F.col("embedding").alias("qv"), F.col("space").alias("q_space"))
    a = made(head).select(id_col, F.col("embedding").alias("av"), F.col("space").alias("a_space"))
    near = F.when(F.col("q_space") == F.col("a_space"), dot(F.col("qv"), F.col("av"))).otherwise(0.0)
    value = F.round((near + 1) / 2, 3)
    return q.join(a, id_col).select(id_col, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("relevance"))
