"""Nearest neighbours by an int8 block matrix join.

Queries and candidates are dealt into stripes by a hash of their id; each query stripe meets each
candidate stripe in one tile. A tile multiplies int8 codes (in floats wide enough to be exact), turns the products into
cosines with proven quantisation error bounds, drops every pair whose upper bound is under the
k-th best lower bound, recomputes the rest in double precision and merges them into a heap per query.
Tiles' heaps are merged by a ranked window per query. Nothing is missed: the search is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in a stripe of candidates at most, about; a stripe of queries has half as many.
STRIPE_CELLS = 1 << 19
QUERY_ROWS = 512
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(rows: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float64 rows in the order of id; repeated ids keep their least vector."""
    ids = rows["id"].to_numpy()
    flat = rows["vec"].combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    x = np.asarray(flat.flatten().cast(pa.float64())).reshape(-1, dim)
    order = np.argsort(ids, kind="stable")
    ids, starts = np.unique(ids[order], return_index=True)
    rows = order[starts]
    for i in np.flatnonzero(np.diff(starts, append=len(order)) > 1):
        same = order[starts[i] : starts[i + 1] if i + 1 < len(starts) else len(order)]
        rows[i] = min(same.tolist(), key=lambda r: x[r].tolist())
    return ids, x[rows]


def _unit(x: np.ndarray) -> np.ndarray:
    y = x / np.abs(x).max(axis=1, keepdims=True)
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def _codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the length of what rounding lost, of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127.0
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((unit - code * scale[:, None]) ** 2).sum(axis=1))
    return code, scale, lost


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows; such as have very large or very small components are scaled first, so that no square overflows or vanishes."""
    most = np.stack([np.abs(x).max(axis=1, initial=0.0) for x in (a, b)])
    odd = ((most > 1e100) | (most < 1e-100)).any(axis=0)
    if odd.any():
        a, b = a.copy(), b.copy()
        a[odd] /= np.abs(a[odd]).max(axis=1, keepdims=True)
        b[odd] /= np.abs(b[odd]).max(axis=1, keepdims=True)
    dot = lambda u, v: np.einsum("ij,ij->i", u, v)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def tile(queries: tuple[np.ndarray, np.ndarray], candidates: tuple[np.ndarray, np.ndarray], k: int) -> list[tuple[int, int, float]]:
    """The ``k`` nearest candidates of each query within one tile; ids must rise in both."""
    q_ids, q = queries
    c_ids, c = candidates
    # Of equal vectors only the k + 1 smallest ids can be among the k nearest of anything.
    seen: dict[bytes, int] = {}
    keep = np.zeros(len(c_ids), dtype=bool)
    for i, row in enumerate(c):
        seen[key] = n = seen.get(key := row.tobytes(), 0) + 1
        keep[i] = n <= k + 1
    c_ids, c = c_ids[keep], c[keep]
    c_code, c_scale, c_lost = _codes(_unit(c))
    # Sums of products of codes are exact in float32 up to 2 ** 24.
    exact = np.float32 if c.shape[1] * 127 * 127 < 1 << 24 else np.float64
    c_code = c_code.astype(exact).T
    slack = 1e-5 + 1e-6  # float32 products of scales
    out = []
    for at in range(0, len(q_ids), QUERY_ROWS):
        ids, x = q_ids[at : at + QUERY_ROWS], q[at : at + QUERY_ROWS]
        code, scale, lost = _codes(_unit(x))
        near = (code.astype(exact) @ c_code).astype(np.float32) * scale.astype(np.float32)[:, None] * c_scale.astype(np.float32)
        bound = (lost[:, None] * (1 + c_lost) + c_lost * (1 + lost[:, None]) + lost[:, None] * c_lost + slack).astype(np.float32)
        own = np.searchsorted(c_ids, ids)
        hit = own < len(c_ids)
        hit[hit] = c_ids[own[hit]] == ids[hit]
        low = near - bound
        low[np.flatnonzero(hit), own[hit]] = -np.inf
        kth = np.full(len(ids), -np.inf, dtype=np.float32) if len(c_ids) <= k else np.partition(low, len(c_ids) - k, axis=1)[:, len(c_ids) - k]
        alive = near + bound >= kth[:, None]
        alive[np.flatnonzero(hit), own[hit]] = False
        rows, cols = np.nonzero(alive)
        heaps: dict[int, list[tuple[float, int]]] = {}
        for cut in range(0, len(rows), 1 << 16):
            r, s = rows[cut : cut + (1 << 16)], cols[cut : cut + (1 << 16)]
            for i, score, vec in zip(r.tolist(), _cosines(x[r], c[s]).tolist(), c_ids[s].tolist(), strict=True):
                heap, item = heaps.setdefault(i, []), (score, -vec)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        out += [(int(ids[i]), -v, s) for i, heap in heaps.items() for s, v in heap]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", stripe_cells: int = STRIPE_CELLS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows by cosine for each row where ``is_query``.

    Nearest first, ties to the smaller id, a row never finds its own id. Rows with a null id, or a vector that is
    null, empty, zero or holds a null or non-finite component, take no part; only vectors of equal
    length meet. Of rows that repeat an id the least vector counts. With fewer than ``k`` candidates
    all are returned. Other columns are not read.
    """
    finite = F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite & F.exists(vec_col, lambda v: v != 0)
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.size(vec_col).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("q"), F.max("dim").alias("dim")).first()
    per = max(256, stripe_cells // max(size["dim"] or 1, 1))
    c_stripes, q_stripes = max(1, -(-size["n"] // per)), max(1, -(-(size["q"] or 0) // max(128, per // 2)))
    stripe = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("id", "vec", "dim", stripe(c_stripes, 1).alias("c"), every(q_stripes).alias("q"))
    queries = rows.where("asks").select("id", "vec", "dim", stripe(q_stripes, 2).alias("q"), every(c_stripes).alias("c"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _OUT.empty_table()
        dim = left["dim"][0].as_py()
        found = tile(_matrix(left, dim), _matrix(right, dim), k)
        return pa.table([pa.array(x, t) for x, t in zip(zip(*found, strict=True), _OUT.types, strict=True)], schema=_OUT) if found else _OUT.empty_table()

    keys = ["dim", "q", "c"]
    tiles = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
