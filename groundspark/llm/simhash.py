"""SimHash near-duplicate groups by meeting variants of fingerprint halves.

A 64-bit fingerprint is cut into two halves of 32 bits. Of 3 differing bits one half holds at most
one, so each half emits all its variants within half the radius (3 // 2 = 1: itself and 32
one-bit neighbours) and meets the untouched halves of the others in a shuffle on the variant.
Pairs that collide are deduplicated by an order on the fingerprints and verified on all 64 bits.
Emitting the ball of radius 2 over all 64 bits instead would mean 2081 rows a fingerprint.

Halves shared by very many distinct fingerprints would make a quadratic number of pairs. They go
another, equally exact way: there the *other* half emits its ball too, and whatever meets in one
bucket is known to be within the radius, so a star to the bucket's least member replaces the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.llm.batches import column, column_bytes, parts, small_batches
from groundspark.operators.components import connected_components
from groundspark.runtime import cut

HALF = 32
#: Distinct fingerprints that may share one half before the star form takes over.
HOT_HALF = 256


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of the XXH64 of word shingles, repeats included; 0 where there is no word."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    norm = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    first = (ends - lengths)[: len(last)]
    digest = xxhash.xxh64_intdigest
    n, ones = len(last), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        pairs = zip(first[at : at + 65536].tolist(), last[at : at + 65536].tolist(), strict=True)
        hashes = np.array([digest(norm[a:b], seed) for a, b in pairs], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` for every row, fp the fingerprint as a signed long."""
    id_type = docs.schema[id_col].dataType
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            marks = np.fromiter(
                (fingerprint(t, shingle) for t in column_bytes(batch, "text")), dtype=np.uint64, count=batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(marks.view(np.int64))], ["id", "fp"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {id_type.simpleString()}, fp long")


def _half(side: int, fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF)) if side == 0 else F.shiftrightunsigned(fp, HALF)


def _ball(radius: int) -> list[int]:
    """Masks of at most ``radius`` bits of a half."""
    masks = [0] + [1 << i for i in range(HALF)]
    if radius > 1:
        masks += [(1 << i) | (1 << j) for i in range(HALF) for j in range(i)]
    return masks


def _spread(df: DataFrame, source: str, radius: int, target: str) -> DataFrame:
    """A row for each value of ``source`` within ``radius`` bits, named ``target``."""
    masks = F.array(*[F.lit(m).cast("long") for m in _ball(radius)])
    return df.withColumn("_mask", F.explode(masks)).withColumn(target, F.col(source).bitwiseXOR(F.col("_mask"))).drop("_mask")


def near_links(fps: DataFrame, radius: int = 3, hot_half: int = HOT_HALF) -> DataFrame:
    """Links ``(src, dst)`` between distinct fingerprints (column ``fp``) whose closure equals that of all pairs within ``radius``.

    ``radius`` is 1 to 3. Pairs through halves held by ``hot_half`` fingerprints at most are all
    returned; those through hotter halves are returned as stars over exact links.
    """
    if not 1 <= radius <= 3:
        raise ValueError("the halves meet for a radius of 1 to 3")
    # Each fingerprint becomes 66 rows, so what an earlier stage packed into few partitions is spread first.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = fps.repartition(tasks, "fp").select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("side"), _half(s, F.col("fp")).alias("half"), _half(1 - s, F.col("fp")).alias("rest")) for s in (0, 1)])
        ).alias("h"),
    ).select("fp", "h.side", "h.half", "h.rest")
    hot = cut(own.groupBy("side", "half").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_half).select("side", "half"))
    probes = _spread(own, "half", radius // 2, "key").select("side", "key", "fp", "rest", (F.col("key") == F.col("half")).alias("same"))
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    if hot.isEmpty():
        cold_own = own
    else:
        cold_own = own.join(hot, ["side", "half"], "left_anti")
    # Spark takes rows for as few after explode() as before it, so these joins must not be broadcast by its estimate.
    pairs = (
        probes.alias("a")
        .join(cold_own.hint("merge").alias("b"), (F.col("a.side") == F.col("b.side")) & (F.col("a.key") == F.col("b.half")) & near & _ordered(hot_half, hot))
        .select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    )
    if cold_own is own:
        return pairs
    # Hot halves: A and P emit one bit of the rest, B the remaining two; A meets A, B and P within 3.
    hot_key = hot.select("side", F.col("half").alias("key"))
    members = own.join(hot, ["side", "half"], "left_semi").select("side", F.col("half").alias("key"), "fp", "rest")
    centres = _spread(members, "rest", radius // 2, "bucket").groupBy("side", "key", "bucket").agg(F.min("fp").alias("centre"))
    outer = _spread(members, "rest", radius - radius // 2, "bucket")
    strangers = probes.where(~F.col("same")).join(hot_key, ["side", "key"], "left_semi")
    beside = _spread(strangers, "rest", (radius - 1) - radius // 2, "bucket")
    stars = (
        outer.select("side", "key", "bucket", "fp")
        .unionByName(beside.select("side", "key", "bucket", "fp"))
        .join(centres.hint("merge"), ["side", "key", "bucket"])
        .where("fp <> centre")
        .select(F.col("fp").alias("src"), F.col("centre").alias("dst"))
    )
    return pairs.unionByName(stars.distinct())


def _ordered(hot_half: int, hot: DataFrame) -> Column:
    """With no hot half each pair comes from both ends, so one order is enough."""
    return F.col("a.fp") < F.col("b.fp") if hot.isEmpty() else F.col("a.fp") != F.col("b.fp")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 3,
    hot_half: int = HOT_HALF,
) -> DataFrame:
    """One row ``(id_col, fp, component_id)`` for each row of ``docs``.

    ``fp`` is the signed fingerprint, ``component_id`` the smallest non-null id among the rows
    reachable over links of ``radius`` bits at most. Null and blank texts have the
    fingerprint zero and link like any other. Rows with a null id take part; a group of such
    rows alone has a null component. Repeated rows are kept and share their component. An empty
    table gives an empty result. Columns beside the two named are not read.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    member = connected_components(near_links(distinct.select("fp"), radius, hot_half))
    linked = distinct.join(member, distinct["fp"] == member["node"])
    roots = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = linked.join(roots, "component").select("fp", "component_id")
    # Written first, so that the last join shuffles both its sides and a fingerprint of very many copies can be split.
    lookup = cut(distinct.join(groups, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return marked.join(lookup, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")
