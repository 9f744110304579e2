"""Sharding by proportional stratified interleaving, with DataFrame functions alone.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is its rank,
moved by a seeded offset of the source, over the source's row count. Sorting by fractional rank
interleaves the sources in proportion, so any cut of that order matches the mixture. Both rankings
are two-level: an order-preserving bucket of the sort key is counted, a running sum over the small
table of buckets gives each its offset, and only rows of one bucket are ranked together. A source
has buckets in proportion to its rows, so a hot one is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundspark.runtime import cut

#: Rows that are ranked together in a task, about; buckets of a ranking are summed up in one sorted run.
BUCKET_ROWS = 4000
SEED = "interleave-1"
#: Copies of a row that one task makes at once.
REPEATS = 100_000


def _ranked(df: DataFrame, group: list[str], bucket: str, order: list[str], out: str, weight: str | None = None) -> DataFrame:
    """Row number from 0 within ``group`` by (bucket, order), where bucket never falls along order; a row counts ``weight`` times if given."""
    each = F.lit(1) if weight is None else F.col(weight)
    counts = df.groupBy(*group, bucket).agg(F.sum(each).alias("_in_bucket"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, bucket, F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = df.withColumn("_in", F.coalesce(F.sum(each).over(inside), F.lit(0)))
    cond = [numbered[c].eqNullSafe(offsets[c]) for c in [*group, bucket]]
    return numbered.join(offsets, cond).select(*[numbered[c] for c in df.columns], (F.col("_in") + F.col("_before")).alias(out))


def _repeated(df: DataFrame, times: str, out: str) -> DataFrame:
    """Each row ``times`` times, with ``out`` counting from 0. Rows that stand for very many are taken apart over all tasks."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = F.lit(REPEATS).cast("long")
    few = df.where(F.col(times) <= REPEATS).withColumn("_from", F.lit(0).cast("long")).withColumn("_to", F.col(times) - 1)
    many = df.where(F.col(times) > REPEATS).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, step))).repartition(tasks, "_from")
    both = few.unionByName(many.withColumn("_to", F.least(F.col("_from") + step, F.col(times)) - 1))
    return both.withColumn(out, F.explode(F.sequence("_from", "_to"))).drop("_from", "_to", times)


def interleave(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: str = SEED,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``(id_col, source_col, size, text_crc32, shard, slot)`` for every row.

    ``size`` is the text's UTF-8 bytes plus 1, ``slot`` counts from 0 without gaps in each shard, and shard
    sizes in rows differ by one at most. A null source is a source of its own, a null text has no
    bytes (crc32 0). Rows are shuffled by the MD5 of seed, id, text checksum and size, so the result does not depend
    on the order or partitioning of the input; a null id counts as an empty one, and whole repeats are
    interchangeable. An empty table gives no rows.
    """
    word = lambda c: F.conv(F.substring(c, 1, 8), 16, 10).cast("long")
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text_col), F.lit(0)).cast("long").alias("crc"),
    )
    mixed = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("crc").cast("string"), F.col("size").cast("string"))
    slim = cut(slim.withColumn("mix", F.md5(mixed)))
    totals = slim.groupBy(F.col("source").alias("source_t")).agg(F.count(F.lit(1)).alias("in_source"))
    n = slim.count()
    # Whole repeats are one row with a count until they have their ranks, so that they are no hot bucket.
    distinct = slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("times"))
    known = distinct.join(totals, distinct["source"].eqNullSafe(F.col("source_t"))).drop("source_t")
    own_parts = F.ceil(F.col("in_source") / bucket_rows)
    first = _ranked(known.withColumn("part", F.floor(word("mix") * own_parts / F.lit(float(1 << 32))).cast("int")), ["source"], "part", ["mix", "id", "crc", "size"], "rank", "times")
    first = _repeated(first, "times", "nth").withColumn("rank", F.col("rank") + F.col("nth"))
    offset = word(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit(""))))) / F.lit(float(1 << 32))
    spread = first.select("id", "source", "size", "crc", "mix", ((F.col("rank") + offset) / F.col("in_source")).alias("fraction"))
    parts = max(1, -(-n // bucket_rows))
    spread = spread.withColumn("part", F.least(F.floor(F.col("fraction") * parts), F.lit(parts - 1)).cast("int"))
    placed = _ranked(spread, [], "part", ["fraction", "source", "mix", "id", "crc", "size"], "place")
    shard = F.expr(f"cast(place * {shards} div {max(n, 1)} as int)")
    start = F.expr(f"(shard * cast({n} as bigint) + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("place") - start)
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")
    )
