"""Settings, passed explicitly; defaults are those of the surveyed service."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chunk_target: int = 384
    chunk_overlap: int = 64
    chunk_min: int = 40
    embedding_dim: int = 384
    rrf_k: int = 60
    graph_weight: float = 1.25
    dense_top_k: int = 8
    bm25_top_k: int = 8
    graph_top_k: int = 8
    final_top_k: int = 5
    graph_depth: int = 2
    graph_max_nodes: int = 25
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    entailment_threshold: float = 0.65
    cite_threshold: float = 0.4
    min_claim_words: int = 4
    context_chars: int = 512
