"""Line deduplication by probing minimal perfect hashes.

Lines are hashed in the tasks; Spark counts the ids of every distinct hash. All distinct hashes are dealt into shards, and a
task builds for each shard a minimal perfect hash (levels of bit arrays: a key that is alone in its slot stays, the
others go to the next level) over compact arrays of fingerprints and counts. The documents' hashes probe the arrays, so
lines are never joined to lines, and only hits go back to the documents. A shard's probes are dealt into groups of bounded size,
each with a copy of the shard's arrays, so a line that most documents hold is no hot key.

Where the repeated lines of the corpus are few enough to be broadcast (their number is counted first), one index of them with whole
hashes is probed beside the texts instead, and neither probes nor texts are shuffled. Both ways give the same rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.batches import column, column_bytes, parts, small_batches
from groundspark.runtime import cut

#: Keys in a shard, and probes in a group, about; repeated lines that are broadcast at most.
SHARD_KEYS = 50_000
GROUP_PROBES = 500_000
BROADCAST_KEYS = 300_000
LEVELS = 24


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class LineIndex:
    """Minimal perfect hash over ``h1`` with arrays of fingerprints and counts in its order, and the keepers of frequent keys.

    In a shard every key that probes is in the index, so 16 bits of ``h2`` are kept. With ``whole`` strangers may probe too, and
    all 128 bits are kept and compared. Counts stop at ``least``, beyond which they no longer matter.
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray, least: int, whole: bool = False) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []  # words of bits, keys before each word, slots
        left, placed, order = np.arange(len(h1)), 0, []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-2 * len(left) // 64) * 64
            slot = (_mix(h1[left], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            before = placed + np.cumsum(alone) - alone
            self.levels.append((np.packbits(alone, bitorder="little").view("<u8"), before[::64].astype(np.uint32), size))
            mine = alone[slot]
            order.append(left[mine][np.argsort(slot[mine])])
            placed, left = placed + len(order[-1]), left[~mine]
        at = np.concatenate([*order, left])
        self.least = least
        self.marks, self.keys = (h2[at], h1[at]) if whole else (h2[at].astype(np.uint16), None)
        self.counts = np.minimum(counts[at], least).astype(np.min_scalar_type(least))
        self.often = np.flatnonzero(self.counts >= least)
        self.keepers = keepers[at][self.often]
        #: Keys that no level could part (equal h1) are looked up whole.
        self.spare = {(int(h1[i]), int(h2[i])): placed + j for j, i in enumerate(left)}

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Place of each key in the arrays, -1 where the fingerprint, or the whole hash, says it isn't in the index."""
        place, left = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1))
        for level, (words, before, size) in enumerate(self.levels):
            slot = (_mix(h1[left], level) % np.uint64(size)).astype(np.int64)
            bit, word = (slot & 63).astype(np.uint64), words[slot >> 6]
            on = (word >> bit) & np.uint64(1) == 1
            lower = word[on] & ((np.uint64(1) << bit[on]) - np.uint64(1))
            place[left[on]] = before[slot[on] >> 6] + np.bitwise_count(lower)
            left = left[~on]
        for i in left if self.spare else ():
            place[i] = self.spare.get((int(h1[i]), int(h2[i])), -1)
        inside = place >= 0
        at = place[inside]
        same = self.marks[at] == h2[inside].astype(self.marks.dtype)
        inside[inside] = same if self.keys is None else same & (self.keys[at] == h1[inside])
        return np.where(inside, place, -1)

    def gone(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which lines go: their count in the index reaches the threshold and another row keeps them."""
        if not len(h1) or not len(self.counts):
            return np.zeros(len(h1), dtype=bool)
        place = self.find(h1, h2)
        out = (place >= 0) & (self.counts[place] >= self.least)
        out[out] = self.keepers[np.searchsorted(self.often, place[out])] != ids[out]
        return out


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Stripped, ASCII-lower-cased line, or None if under ``min_chars`` code points."""
    key = line.strip().lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(id, h1, h2)``: the distinct hashes of the lines of each row."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            rows, keys = [], []
            for i, text in enumerate(column_bytes(batch, "text")):
                own = {k for k in (line_key(x, min_chars) for x in (text or b"").split(b"\n")) if k is not None}
                rows += [i] * len(own)
                keys += own
            h1, h2 = _hashes(keys)
            ids = column(batch, "id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["id", "h1", "h2"])

    return docs.mapInArrow(run, f"id {id_type}, h1 long, h2 long")


def _unsigned(col: pd.Series) -> np.ndarray:
    return col.to_numpy(dtype=np.int64).view(np.uint64)


def _index(pdf: pd.DataFrame, least: int, whole: bool = False) -> LineIndex:
    return LineIndex(_unsigned(pdf["h1"]), _unsigned(pdf["h2"]), pdf["n"].to_numpy(), pdf["keeper"].to_numpy(), least, whole)


def drop_repeated_lines(
    docs: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_keys: int = SHARD_KEYS,
    group_probes: int = GROUP_PROBES,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """``docs`` with ``text_col`` rid of repeated lines, plus ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of
    ``min_chars`` code points found under ``min_docs`` different ids lose all their lines except in the rows of the
    largest id that holds them; rows that repeat an id count once and share its fate. A null or empty text is one empty line and
    stays as it is. Rows with a null id don't count and stay as they are. Ids may be of any type that
    can be ordered (strings by their bytes). Columns named ``n_lines`` or ``n_dropped`` give way to the new ones; all others are kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    lines = cut(_line_hashes(slim, min_chars))
    repeated = cut(slim.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if not repeated.isEmpty():
        lines = cut(lines.join(repeated, "id", "left_anti").unionByName(lines.join(repeated, "id", "left_semi").distinct()))
    counted = cut(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")))
    frequent = F.col("n") >= min_docs
    size = counted.agg(F.count(F.lit(1)).alias("keys"), F.count_if(frequent).alias("frequent")).first()
    own = docs.select(*keep, F.col(id_col).alias("_id"))
    if size["frequent"] <= broadcast_keys:
        shared = spark.sparkContext.broadcast(_index(counted.where(frequent).toPandas(), min_docs, whole=True))
        return own.mapInArrow(_remover(keep, text_col, min_chars, shared), _schema(docs, keep))

    shards = -(-size["keys"] // shard_keys)
    keyed = F.pmod(F.shiftright("h1", 20), F.lit(shards)).cast("int").alias("shard")
    groups = cut(counted.groupBy(keyed).agg(F.ceil(F.sum("n") / group_probes).cast("int").alias("groups")))
    id_type = slim.schema["id"].dataType.simpleString()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "index": [pickle.dumps(_index(pdf, min_docs), protocol=5)]})

    def probe(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"id": pd.Series(dtype="object"), "mark": pd.Series(dtype="int64")})
        h1, h2 = _unsigned(rows["h1"]), _unsigned(rows["h2"])
        gone = pickle.loads(index["index"].iloc[0]).gone(h1, h2, rows["id"].to_numpy())
        return pd.DataFrame({"id": rows["id"][gone], "mark": (h1 ^ h2).view(np.int64)[gone]})

    built = counted.select(keyed, "h1", "h2", "n", "keeper").groupBy("shard").applyInPandas(build, "shard int, index binary")
    copies = built.join(groups, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "index")
    dealt = lines.select(keyed, "id", "h1", "h2").join(groups, "shard").withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    probes = dealt.select("shard", "group", "id", "h1", "h2").groupBy("shard", "group")
    hits = probes.cogroup(copies.groupBy("shard", "group")).applyInPandas(probe, f"id {id_type}, mark long")
    gone = hits.groupBy("id").agg(F.collect_set("mark").alias("_gone")).withColumnRenamed("id", "_gone_id")
    joined = own.join(gone, F.col("_id") == F.col("_gone_id"), "left").drop("_gone_id")
    return joined.mapInArrow(_remover(keep, text_col, min_chars), _schema(docs, keep))


def _schema(docs: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields) + ", n_lines long, n_dropped long"


def _remover(keep: list[str], text_col: str, min_chars: int, shared=None):
    """Takes out the lines that a broadcast index says go or, without one, those that the shards sent back (``_gone``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text_col):
            texts = [(t or b"").split(b"\n") for t in column_bytes(batch, text_col)]
            ids = column(batch, "_id").to_pylist()
            gone = column(batch, "_gone").to_pylist() if shared is None else ids
            keyed = [(i, j, k) for i, lines in enumerate(texts) if gone[i] is not None for j, x in enumerate(lines) if (k := line_key(x, min_chars)) is not None]
            h1, h2 = _hashes([k for *_, k in keyed])
            if shared is None:
                marks = (h1 ^ h2).view(np.int64).tolist()
                sets = {i: set(gone[i]) for i in {i for i, *_ in keyed}}
                drop = [m in sets[i] for m, (i, *_) in zip(marks, keyed, strict=True)]
            else:
                drop = shared.value.gone(h1, h2, np.array([ids[i] for i, *_ in keyed], dtype=object)).tolist()
            out: dict[int, set[int]] = {}
            for (i, j, _), d in zip(keyed, drop, strict=True):
                if d:
                    out.setdefault(i, set()).add(j)
            made, n_dropped = column_bytes(batch, text_col), [len(out.get(i, ())) for i in range(len(texts))]
            for i, lost in out.items():
                made[i] = b"\n".join([x for j, x in enumerate(texts[i]) if j not in lost])
            cols = [pa.array(made, pa.large_binary()).cast(batch.schema.field(c).type) if c == text_col else column(batch, c) for c in keep]
            counts = [pa.array([len(lines) for lines in texts], pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *counts], [*keep, "n_lines", "n_dropped"])

    return run
