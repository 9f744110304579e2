"""Registered queries of the retrieval engine with their DuckDB equivalents."""

from __future__ import annotations

import inspect
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from groundspark.plans import oracles, queries

__all__ = ["ORACLES", "QUERIES", "WHOLE", "flagship"]

QUERIES = {name: f for name, f in vars(queries).items() if inspect.isfunction(f) and f.__module__ == queries.__name__ and not name.startswith("_")}

#: The same queries as the engine does them, where the plain name fixes a smaller job (folded texts, short vectors, few rounds, no graph).
WHOLE = {f"{name}_whole": partial(f, job=queries.WHOLE) for name, f in QUERIES.items() if "job" in inspect.signature(f).parameters}

ORACLES = oracles.ORACLES | {name: oracles.WHOLE[name.removesuffix("_whole")] for name in WHOLE}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of all benchmark texts over all documents."""
    return WHOLE["hybrid_search_whole"](spark, sf_dir)
