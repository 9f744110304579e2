"""Rank fusion, reranking and hybrid search."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.config import Config
from groundspark.functions.text import content_tokens
from groundspark.operators.embedding import embed
from groundspark.operators.lexical import bm25_topk
from groundspark.operators.vectors import dense_topk
from groundspark.runtime import cut, picked

CHANNELS = ("dense", "bm25", "graph")


def rrf_fuse(rankings: DataFrame, cfg: Config = Config(), id_col: str = "chunk_id") -> DataFrame:
    """Reciprocal ranks of ``(query_id, modality, id_col, rank)`` summed, with a rank column per channel."""
    weight = F.when(F.col("modality") == "graph", cfg.graph_weight).otherwise(1.0)
    ranks = [F.max(F.when(F.col("modality") == m, F.col("rank"))).alias(f"{m}_rank") for m in CHANNELS]
    return rankings.groupBy("query_id", id_col).agg(F.sum(weight / (cfg.rrf_k + F.col("rank"))).alias("rrf_score"), *ranks)


def rerank(candidates: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """Top ``k`` per query of candidates with ``query``, ``content``, ``breadcrumbs``, ``rrf_score`` and channel ranks.

    Adds ``score`` and ``rank``. Ordered by the unrounded score; a query without tokens keeps the fused order.
    """
    scored = candidates.withColumn("q", content_tokens(F.col("query"))).withColumn("c", content_tokens(F.col("content")))
    crumbs = F.lower(F.array_join("breadcrumbs", " "))
    hits = F.size(F.filter("q", lambda t: F.contains(crumbs, t)))
    channels = sum(F.col(f"{m}_rank").isNotNull().cast("int") for m in CHANNELS)
    full = 10 * F.col("rrf_score") + 0.4 * F.size(F.array_intersect("q", "c")) / F.greatest(F.size("q"), F.lit(1)) + 0.15 * F.least(hits, F.lit(3)) + 0.25 * F.greatest(channels - 1, F.lit(0))
    scored = scored.withColumn("score", F.when(F.size("q") > 0, full).otherwise(F.col("rrf_score")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 10)), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("q", "c")


def lexical_text() -> Column:
    """What BM25 indexes of a chunk: title, breadcrumbs and content."""
    return F.concat_ws(" ", "title", F.array_join("breadcrumbs", " "), "content")


def rankings(
    chunks: DataFrame,
    queries: DataFrame,
    cfg: Config = Config(),
    graph: DataFrame | None = None,
    vectors: DataFrame | None = None,
    channels: tuple[str, ...] = CHANNELS,
    provider: Callable | None = None,
    lexical: Callable[[DataFrame, int], DataFrame] | None = None,
    nearest: Callable[[DataFrame, int], DataFrame] | None = None,
    guard: bool = False,
) -> DataFrame:
    """``(query_id, chunk_id, modality, rank)`` of the dense and BM25 channels, and of ``graph`` rankings if given.

    ``chunks`` has ``chunk_id``, ``title``, ``content`` and ``breadcrumbs``; ``queries`` has ``query_id`` and ``query``;
    ``graph`` has ``(query_id, chunk_id, rank)``. ``vectors`` may hold ready embeddings of the chunks, made by the same ``provider``; ``lexical`` and ``nearest`` may
    search what is stored instead. With ``guard`` each channel is worked out at once, and one that fails is empty.
    """

    def dense() -> DataFrame:
        if nearest is not None:
            return nearest(queries, cfg.dense_top_k)
        held = vectors
        if held is None:
            held = embed(chunks.select("chunk_id", F.concat_ws(": ", "title", "content").alias("text")), cfg.embedding_dim, "chunk_id", provider=provider)
        asked = embed(queries.select("query_id", F.col("query").alias("text")), cfg.embedding_dim, "query_id", provider=provider)
        return dense_topk(held, asked, cfg.dense_top_k)

    def bm25() -> DataFrame:
        if lexical is not None:
            return lexical(queries, cfg.bm25_top_k)
        return bm25_topk(chunks.select("chunk_id", lexical_text().alias("text")), queries, cfg.bm25_top_k, cfg)

    made = {"dense": dense, "bm25": bm25, "graph": lambda: graph.where(F.col("rank") <= cfg.graph_top_k)}
    out = None
    for name in (n for n in CHANNELS if n in channels and (n != "graph" or graph is not None)):
        try:
            part = made[name]().select("query_id", "chunk_id", F.lit(name).alias("modality"), F.col("rank").cast("int").alias("rank"))
            part = cut(part) if guard else part
        except Exception as error:
            if not guard:
                raise
            logging.getLogger(__name__).warning("channel %s failed and counts as empty: %s", name, error)
            part = queries.join(chunks.limit(0).select("chunk_id")).select("query_id", "chunk_id", F.lit(name).alias("modality"), F.lit(0).alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


def hybrid_search(
    chunks: DataFrame,
    queries: DataFrame,
    cfg: Config = Config(),
    graph: DataFrame | None = None,
    k: int | None = None,
    vectors: DataFrame | None = None,
    channels: tuple[str, ...] = CHANNELS,
    provider: Callable | None = None,
    lexical: Callable[[DataFrame, int], DataFrame] | None = None,
    nearest: Callable[[DataFrame, int], DataFrame] | None = None,
    guard: bool = False,
) -> DataFrame:
    """The channels of ``rankings``, fused and reranked."""
    found = rankings(chunks, queries, cfg, graph, vectors, channels, provider, lexical, nearest, guard)
    fused = cut(rrf_fuse(found, cfg))
    return rerank(fused.join(picked(chunks, fused, "chunk_id"), "chunk_id").join(queries, "query_id"), k or cfg.final_top_k)
