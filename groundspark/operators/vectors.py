"""Dense vector store: upsert, delete, filtered exact search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from groundspark.runtime import cut

#: Bytes of query vectors that are broadcast at once; more queries are searched block by block.
MAX_QUERY_BYTES = 32 << 20
#: Queries and rows whose scores are worked out at once in a task.
TILE_QUERIES, TILE_ROWS = 256, 4096


def unit(vec: Column) -> Column:
    """Scaled to length 1 in double precision; a zero vector stays."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


def upsert(store: DataFrame, new: DataFrame, id_col: str, order_col: str | None = None) -> DataFrame:
    """``store`` with the rows of ``new`` put in by id; of rows of ``new`` that share an id the last by ``order_col`` counts."""
    rank = Window.partitionBy(id_col).orderBy(F.desc(order_col or id_col))
    latest = new.withColumn("_rn", F.row_number().over(rank)).where("_rn = 1").select(*store.columns)
    return store.join(latest.select(id_col), id_col, "left_anti").select(*store.columns).unionByName(latest)


def delete(store: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``store`` without rows whose ``key`` (a chunk or document id) is in ``gone``."""
    return store.join(gone.select(key).distinct(), key, "left_anti").select(*store.columns)


def get(store: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``store`` whose ``key`` is in ``wanted``, each once however often it is asked for."""
    return store.join(wanted.select(key).distinct(), key, "left_semi").select(*store.columns)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` highest scores of each query, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], ids[kept], scores[kept]


def _search(vectors: DataFrame, matrix: np.ndarray, k: int, id_col: str, vec_col: str) -> DataFrame:
    """``(q, id_col, score)`` with ``q`` the row of ``matrix``. Scores are made in tiles of queries and rows, and only what may be among the best leaves a tile."""
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, held, schema = shared.value, None, None
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(start, TILE_ROWS)
                schema = part.schema.field(0).type
                found = part.column(0).to_numpy(zero_copy_only=False)
                x = np.asarray(part.column(1).flatten().cast(pa.float64())).reshape(len(found), -1)
                norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                x = x / np.where(norm > 0, norm, 1)
                parts = [] if held is None else [held]
                for q in range(0, len(asked), TILE_QUERIES):
                    scores = np.round(asked[q : q + TILE_QUERIES] @ x.T, 12)
                    least = np.partition(scores, -k, axis=1)[:, -k, None] if scores.shape[1] > k else -np.inf
                    row, col = np.nonzero(scores >= least)
                    parts.append(_best(row + q, found[col], scores[row, col], k))
                held = _best(*(np.concatenate(c) for c in zip(*parts, strict=True)), k)
        if held is not None:
            query, ids, scores = held
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(ids, schema), pa.array(scores)], ["q", id_col, "score"])

    id_type = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vec_col).mapInArrow(run, f"q int, `{id_col}` {id_type}, score double")


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vec_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """Exact cosine top ``k`` of ``vectors`` for each row of ``queries (query_id, embedding)``: adds ``score`` and ``rank``.

    ``where`` filters before the limit. Ties go to the smaller id; ids of queries and vectors may be of any type that can be ordered. Each
    task keeps its own best ``k`` per query, so what is shuffled is k rows per query and task. Blocks of queries are searched one after the other.
    """
    rows = vectors if where is None else vectors.where(where)
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    blocks = max(1, -(-size["n"] * (size["d"] or 1) * 8 // MAX_QUERY_BYTES))
    spark, kind = queries.sparkSession, queries.schema["query_id"].dataType
    parts = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", unit(F.col("embedding")).alias("u")).orderBy("query_id").collect()
        if block:
            names = spark.createDataFrame([(q, r["query_id"]) for q, r in enumerate(block)], StructType([StructField("q", IntegerType()), StructField("query_id", kind)]))
            one = _search(rows, np.array([r["u"] for r in block]), k, id_col, vec_col).join(F.broadcast(names), "q").select("query_id", id_col, "score")
            one = cut(one) if blocks > 1 else one
            parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        parts = spark.createDataFrame([], StructType([StructField("query_id", kind), vectors.schema[id_col], StructField("score", DoubleType())]))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_topk_in_space(vectors: DataFrame, queries: DataFrame, k: int, spaces: tuple[str, ...], id_col: str = "chunk_id") -> DataFrame:
    """``dense_topk`` among the vectors of each query's own ``space``, a column of both sides; vectors of different spaces never meet."""
    parts = [dense_topk(vectors, queries.where(F.col("space") == s), k, id_col, where=F.col("space") == s) for s in dict.fromkeys(spaces)]
    return reduce(DataFrame.unionByName, parts)
