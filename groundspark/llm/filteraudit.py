"""Audit of filters applied in every order, with exact duplicates found by radix tries.

Each row's failures are a mask of bits. The last filter, a text identical to that of a smaller id, comes from tries: texts are
dealt by ranges of prefixes that are lengthened where too much text shares one, and each range inserts its whole texts
into compressed tries whose terminals hold the least id. A traversal names the one id of each text that isn't a duplicate.
Masks are counted, and the counts alone give every order's steps.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.batches import column, column_bytes, parts, small_batches
from groundspark.runtime import cut

FILTERS = "ABCDE"
DUPLICATE = FILTERS.index("E")
#: Bytes of distinct texts that may share a prefix before it is lengthened, and how many prefixes can be that heavy.
PREFIX_BYTES = 1 << 20
HEAVY_PREFIXES = 4096
#: Characters of the first prefix, and the factor by which a heavy one grows.
FIRST_PREFIX, LONGER = 8, 8
#: Bytes of text in a trie beside the scan, which only spares the shuffle repeats; bytes of text in a range, about.
BLOCK_BYTES = 16 << 20
RANGE_BYTES = 32 << 20
_UPPER, _SPECIAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_CONTINUING = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a text fails."""
    words = text.split()  # bytes: ASCII white space only
    chars = len(text.translate(None, _CONTINUING))
    failed = (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * (len(text) - len(text.translate(None, _UPPER))) > 10 * chars,
        len(text.translate(None, _SPECIAL)) < len(text),
    )
    return sum(bad << k for k, bad in enumerate(failed))


class _Node:
    __slots__ = ("below", "label", "least", "mark")

    def __init__(self, label: bytes) -> None:
        self.label, self.below, self.least, self.mark = label, {}, None, None


class TextTrie:
    """Compressed trie over whole texts. The terminal of a text holds the least id inserted with it, and the text's mark."""

    def __init__(self) -> None:
        self.root = _Node(b"")

    def insert(self, text: bytes, own, mark) -> bool:
        """True if the text is new."""
        node, at = self.root, 0
        while at < len(text):
            child = node.below.get(text[at])
            if child is None:
                child = node.below[text[at]] = _Node(text[at:])
            elif not text.startswith(child.label, at):
                shared = _shared(child.label, text, at)
                fork = node.below[text[at]] = _Node(child.label[:shared])
                child.label = child.label[shared:]
                fork.below[child.label[0]] = child
                child = fork
            node, at = child, at + len(child.label)
        new = node.mark is None
        if new or own < node.least:
            node.least, node.mark = own, mark
        return new

    def terminals(self) -> Iterator[tuple[bytes, object, object]]:
        """Text, least id and mark of every distinct text."""
        open_ = [(self.root, b"")]
        while open_:
            node, before = open_.pop()
            text = before + node.label
            if node.mark is not None:
                yield text, node.least, node.mark
            open_ += [(child, text) for child in node.below.values()]


def _shared(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of ``label`` the text has at ``at``: one at least, not all."""
    have, lack = 1, len(label)
    while lack - have > 1:
        middle = (have + lack) // 2
        if text.startswith(label[:middle], at):
            have = middle
        else:
            lack = middle
    return have


def plan_prefixes(texts: DataFrame, most_bytes: int = PREFIX_BYTES) -> tuple[list[tuple[int, set[int]]], int]:
    """Lengths of prefixes, each with the hashes of those that more than ``most_bytes`` of distinct texts share; and all bytes.

    ``texts`` has columns ``text`` and ``mark``, the text's hash. A heavy prefix is lengthened until its texts part or it belongs to one text alone. The driver gets
    at most ``HEAVY_PREFIXES`` hashes for a length, whatever the texts.
    """
    plan, total, length = [], None, FIRST_PREFIX
    while True:
        prefix = F.xxhash64(F.substring("text", 1, length)).alias("prefix")
        if plan:
            texts = texts.where(F.xxhash64(F.substring("text", 1, plan[-1][0])).isin(*plan[-1][1]))
        distinct = texts.select(prefix, "mark", F.octet_length("text").cast("long").alias("b")).distinct()
        sizes = cut(distinct.groupBy("prefix").agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")))
        if total is None:
            total = sizes.agg(F.sum("b")).first()[0] or 0
            most_bytes = max(most_bytes, total // HEAVY_PREFIXES)
        heavy = {r[0] for r in sizes.where((F.col("b") > most_bytes) & (F.col("n") > 1)).select("prefix").collect()}
        plan.append((length, heavy))
        if not heavy:
            return plan, total
        length *= LONGER


def _prefix(text: bytes, plan: list[tuple[int, set[int]]]) -> tuple[str, int]:
    """First characters, and hash, of the shortest prefix that isn't heavy."""
    for length, heavy in plan:
        chars = text[: 4 * length].decode("utf-8", "ignore")[:length]
        digest = xxhash.xxh64_intdigest(chars.encode(), 42)
        digest -= (digest >> 63) << 64
        if digest not in heavy:
            break
    return chars[:FIRST_PREFIX], digest


def first_of_texts(docs: DataFrame, most_bytes: int = PREFIX_BYTES) -> DataFrame:
    """``(id, mark)`` of the least id of every distinct text; ``docs`` has columns ``id`` (not null), ``text`` and ``mark``, the text's hash."""
    plan, total = plan_prefixes(docs, most_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    kind = docs.schema["id"].dataType.simpleString()

    def emit(trie: TextTrie, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for text, least, mark in trie.terminals():
            rows.append((*_prefix(text, shared.value), least, mark, text))
            size += len(text)
            if size > BLOCK_BYTES // 4 or len(rows) == 1000:
                yield _batch(rows, schema)
                rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    def spare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeats within a task's blocks of texts go before the shuffle."""
        trie, size, schema = TextTrie(), 0, None
        for batch in parts(batches, "text"):
            schema = schema or _schema(column(batch, "id").type)
            for own, text, mark in zip(column(batch, "id").to_pylist(), column_bytes(batch, "text"), column(batch, "mark").to_pylist(), strict=True):
                size += (len(text) + 200) * trie.insert(text, own, mark)
            if size > BLOCK_BYTES:
                yield from emit(trie, schema)
                trie, size = TextTrie(), 0
        if schema is not None:
            yield from emit(trie, schema)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by prefix, so one prefix's texts are held at a time."""
        trie, open_ = TextTrie(), None
        for batch in parts(batches, "text"):
            ids = column(batch, "id")
            done = []
            rows = zip(zip(column(batch, "head").to_pylist(), column(batch, "prefix").to_pylist(), strict=True), ids.to_pylist(), column(batch, "mark").to_pylist(), column_bytes(batch, "text"), strict=True)
            for prefix, own, mark, text in rows:
                if prefix != open_:
                    done += [(least, m) for _, least, m in trie.terminals()]
                    trie, open_ = TextTrie(), prefix
                trie.insert(text, own, mark)
            id_type = ids.type
            yield _firsts(done, id_type)
        if open_ is not None:
            yield _firsts([(least, m) for _, least, m in trie.terminals()], id_type)

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    spared = docs.select("id", "text", "mark").mapInArrow(spare, f"head string, prefix long, id {kind}, mark long, text string")
    ranges = spared.repartitionByRange(tasks, "head", "prefix").sortWithinPartitions("head", "prefix")
    return ranges.mapInArrow(settle, f"id {kind}, mark long")


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("head", pa.string()), ("prefix", pa.int64()), ("id", id_type), ("mark", pa.int64()), ("text", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    *others, texts = zip(*rows, strict=True)
    arrays = [pa.array(c, f.type) for c, f in zip(others, schema, strict=False)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.binary()).cast(pa.string())], schema=schema)


def _firsts(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), pa.array([r[1] for r in rows], pa.int64())], ["id", "mark"])


def filter_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", most_bytes: int = PREFIX_BYTES) -> DataFrame:
    """``(id, part, mask, n)``: how many rows with this id and part fail just the filters whose bits are in ``mask``.

    A null text is empty, a null part the empty string. A row is a duplicate (E) if a smaller id has its text anywhere in the table; of
    rows that repeat an id and a text all or none are. Rows with a null id are never duplicates and make none.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("mark"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            masks = pa.array([failures(t) for t in column_bytes(batch, "text")], pa.int32())
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("id", "part", "mark")), masks], ["id", "part", "mark", "mask"])

    kind = docs.schema[id_col].dataType.simpleString()
    judged = slim.mapInArrow(judge, f"id {kind}, part string, mark long, mask int").groupBy("id", "part", "mark", "mask").agg(F.count(F.lit(1)).alias("n"))
    firsts = first_of_texts(slim.where("id is not null"), most_bytes).select(F.col("id").alias("_first"), F.col("mark").alias("_mark"), F.lit(True).alias("_is_first"))
    joined = judged.join(firsts, (F.col("id") == F.col("_first")) & (F.col("mark") == F.col("_mark")), "left")
    duplicate = F.col("id").isNotNull() & F.col("_is_first").isNull()
    mask = F.col("mask").bitwiseOR(F.when(duplicate, 1 << DUPLICATE).otherwise(0))
    return joined.groupBy("id", "part", mask.alias("mask")).agg(F.sum("n").alias("n"))


def _steps() -> list[dict]:
    """Every order of the filters, step by step: the step's filter and those before it, as masks."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(c) for c in order]
        out += [{"filter_order": order, "step": k + 1, "own": bits[k], "before": sum(bits[:k])} for k in range(len(order))]
    return out


def audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    most_bytes: int = PREFIX_BYTES,
) -> DataFrame:
    """A row for each part, order of the filters and step, zeros included; see the columns below.

    ``kept`` rows pass all filters up to this one, ``removed`` fail it and none before, ``redundant`` fail it and one before,
    ``unique_fails`` fail it alone; ``good_lost`` and ``toxic_lost`` are the removed rows that ``labels`` marks so. ``shapley`` is what this
    filter removes, summed over all orders. Labels that repeat an id count as set if any row sets them; a null id has none. An
    empty table has no part, hence no row. Other columns are not read.
    """
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_labelled")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    masks = filter_masks(docs, id_col, text_col, part_col, most_bytes)
    joined = masks.join(marked, F.col("id") == F.col("_labelled"), "left")
    counts = joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order: string, step: int, own: int, before: int>>")
    each = counts.select("*", F.inline(steps))
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    here = fails & ~earlier
    # A row that fails k filters is removed by each of them in one of k orders.
    orders = len(list(permutations(FILTERS)))
    total = lambda cond, n: F.sum(F.when(cond, n).otherwise(0)).cast("long")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier, F.col("n")).alias("kept"),
        total(here, F.col("n")).alias("removed"),
        total(fails & earlier, F.col("n")).alias("redundant"),
        total(F.col("mask") == F.col("own"), F.col("n")).alias("unique_fails"),
        total(here, F.col("good")).alias("good_lost"),
        total(here, F.col("toxic")).alias("toxic_lost"),
        total(fails, F.expr(f"n * ({orders} div bit_count(mask))")).alias("shapley"),
    )
