"""Importance resampling towards a target's distribution over hashed n-gram features.

Tasks intern the n-grams of a batch in an open-addressed table in numpy: keys are XXH64 values, the bytes settle whether a
key is the same n-gram, and a slot holds its bucket and count. What the corpus and the target hold in each bucket is summed
by Spark; the gains of all buckets are one small array. Then a document's occurrences gather the gains by their slots, and
its score adds a seeded Gumbel noise, so that the highest scores are a draw without replacement. Ranks come from a
range-partitioned sort: no task ranks more than its range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.llm.batches import column, column_bytes, parts, small_batches
from groundspark.llm.ngrams import ALPHANUMERIC, Piece, pieces
from groundspark.runtime import cut

BUCKETS = 10_000


class NgramTable:
    """Open addressing with linear probing over the n-grams of a piece: a slot for each distinct one, with its bucket and count.

    A slot names the occurrence that claimed it, which holds the key and the bytes.
    """

    def __init__(self, piece: Piece, start: np.ndarray, size: np.ndarray, buckets: int) -> None:
        #: Slot of every occurrence.
        self.slots = np.empty(len(start), dtype=np.int32)
        slots = 1 << max(4, (3 * len(start) // 2).bit_length())
        self._claims = np.full(slots, -1, dtype=np.int32)
        self._intern(piece, start.astype(np.int32), size.astype(np.int32))
        self.used = np.flatnonzero(self._claims >= 0)
        claims = self._claims[self.used]
        self.bucket, self.count = np.zeros(slots, dtype=np.int32), np.bincount(self.slots, minlength=slots)
        self.bucket[self.used] = piece.crc32(start[claims], size[claims]) % np.uint32(buckets)

    def _intern(self, piece: Piece, start: np.ndarray, size: np.ndarray) -> None:
        key, claims, mask = piece.hashes(start, size), self._claims, len(self._claims) - 1
        left, slot = np.arange(len(start), dtype=np.int32), (key & np.uint64(mask)).astype(np.int32)
        while len(left):
            free = claims[slot] < 0
            claims[slot[free]] = left[free]  # of several, the last stays
            owner = claims[slot]
            same = key[owner] == key[left]
            again = np.flatnonzero(same & (owner != left))
            same[again] = piece.equal(start, size, left[again], owner[again])
            self.slots[left[same]] = slot[same]
            left, slot = left[~same], (slot[~same] + 1) & mask


def _interned(texts: list[bytes | None], longest: int, buckets: int) -> Iterator[tuple[Piece, NgramTable, np.ndarray]]:
    """For each piece of the texts its table, and the text of every occurrence."""
    for piece in pieces(texts, ALPHANUMERIC, longest):
        runs = [piece.runs(n) for n in range(1, longest + 1)]
        owner, start, size = (np.concatenate(x) for x in zip(*runs, strict=True))
        yield piece, NgramTable(piece, start, size, buckets), owner


def feature_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = 2) -> np.ndarray:
    """Occurrences of features in each bucket over all rows; null and empty texts have none."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in parts(batches, "text"):
            for _, table, _ in _interned(column_bytes(batch, "text"), longest, buckets):
                total += np.bincount(table.bucket[table.used], weights=table.count[table.used], minlength=buckets).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    sums = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the smoothed ratio of the target's share to the source's, floored."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(source, target, strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 2) -> DataFrame:
    """``(id, n_words, n_features, weight)`` for every row; ``weight`` is the floored mean gain of its features, 0 without any."""
    small_batches(docs.sparkSession)
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            n = batch.num_rows
            words, features, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for piece, table, owner in _interned(column_bytes(batch, "text"), longest, buckets):
                words += np.bincount(piece.owner[piece.fresh], minlength=n)
                features += np.bincount(owner, minlength=n)
                total += np.rint(np.bincount(owner, weights=shared.value[table.bucket[table.slots]], minlength=n)).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), *map(pa.array, (words, features, weight))], ["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(seed: str, row_id: Column) -> Column:
    """1000 times a standard Gumbel deviate that the seed and the id decide, floored. A null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform)))


def ranked(rows: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Rows numbered from 1 in ``order``, which must tell all rows apart.

    Ranges of the order are sorted each in a task of its own and written; a row's number is its place in its range and the count
    of the ranges before.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_part", part).join(F.broadcast(ranges), "_part")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(out, F.col("_before") + place + 1).drop("_at", "_part", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    min_words: int = 20,
    seed: str = "7",
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = BUCKETS,
    longest: int = 2,
) -> DataFrame:
    """``(id_col, n_features, weight, score, rank)`` for every row of ``docs``.

    Features are all runs of up to ``longest`` words. Of the rows with ``min_words`` words, ``percent`` of a hundred with the
    highest scores are drawn and ranked from 1; ``rank`` is null for all others. Ties go to the smaller id, a null id comes last, and
    whole repeats are interchangeable. Null and empty texts have no word, hence weight 0, and aren't drawn. An empty target
    leaves the gains to the source alone; an empty table gives no rows. Other columns are not read.
    """
    gains = bucket_gains(feature_counts(docs, text_col, buckets, longest), feature_counts(target, target_text_col, buckets, longest))
    scored = weigh(docs, gains, id_col, text_col, longest).withColumn("score", F.col("weight") + gumbel(seed, F.col("id")))
    scored = cut(scored.withColumn("_row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= min_words
    most = percent * scored.where(able).count() // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("_row").asc()]
    drawn = ranked(scored.where(able), order).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
