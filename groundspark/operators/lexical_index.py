"""A stored BM25 index: postings in blocks of neighbouring texts, and searches that skip blocks which can't matter.

Texts are numbered, and a block is what a term has in 256 neighbouring numbers: its postings as arrays, the most
occurrences and the least length among them. These bound every score in the block whatever the corpus's statistics are now, so
an index of many batches needs no rewriting when texts come or go. A stored row holds one block, or successive blocks of a term that has little in
each. Rows are sorted by term and block in small pages, so Parquet skips what a search does not ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.config import Config
from groundspark.functions.text import word_tokens
from groundspark.operators.lexical import best_of, coded
from groundspark.runtime import cut, delete, stored

#: Numbers in a block, as bits, and blocks whose texts are scored together, likewise.
BLOCK_BITS, GROUP_BITS = 8, 4
#: Postings from which a stored row is not filled with further blocks, and words that a task counts at once, about.
FILL, PART_WORDS = 128, 1 << 21
#: Columns of stored rows: ``block`` is the first and ``last`` the last that a row holds, or null if that is the same.
POSTINGS = "term string, block long, last long, held int, most_tf int, least_dl long, numbers array<long>, tfs array<int>, dls array<long>"
#: Bits of a number that count rows of a partition, and partitions of a batch; the rest is the batch's own.
ROW_BITS, PART_BITS = 24, 19
#: The same for Arrow.
_FIELDS = [pa.field(n, t) for n, t in zip([c.split()[0] for c in POSTINGS.split(", ")], [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())])]
#: Options of the written postings: rows in a page.
PAGES = {"parquet.page.row.count.limit": "8"}
#: Terms, runs of blocks and blocks up to which a search names what it needs to the scan; beyond, a join alone picks it.
SCAN_TERMS, SCAN_RUNS, SCAN_BLOCKS = 500, 64, 20_000
#: Blocks that a query scores first, as a multiple of its ``k``.
SEEDS = 4


def number_texts(texts: DataFrame, batch: int, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``(id_col, number, dl, words)`` of ``texts``: a number of its own for each row, close together within a partition. Numbers hold once the result, or ``texts``, is written."""
    at = F.monotonically_increasing_id()
    part, row = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    fits = (part < (1 << PART_BITS)) & (row < (1 << ROW_BITS))
    number = F.lit(batch << (ROW_BITS + PART_BITS)) + F.shiftleft(part, ROW_BITS) + row
    words = F.coalesce(word_tokens(F.col(text_col)), F.array().cast("array<string>"))
    checked = F.when(fits, number).otherwise(F.raise_error(F.lit("too many texts in one batch of the index")).cast("long"))
    return texts.select(id_col, checked.alias("number"), words.alias("words")).withColumn("dl", F.size("words").cast("long"))


def build_postings(numbered: DataFrame) -> DataFrame:
    """Rows of ``numbered (number, dl, words)`` in the stored form, which each task counts for runs of its own texts. Numbers follow one another within a partition, as ``number_texts`` gives them, so no block is in two rows."""
    return numbered.select("number", "dl", "words").mapInArrow(_counting(BLOCK_BITS), POSTINGS)


def _whole_blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.Table]:
    """The rows of ``batches`` in tables of about ``PART_WORDS`` words that end where a block does."""
    waiting, words = [], 0
    for batch in batches:
        waiting.append(batch)
        words += pc.sum(batch.column("dl")).as_py() or 0
        if words >= PART_WORDS:
            rows = pa.Table.from_batches(waiting)
            block = rows["number"].to_numpy() >> bits
            end = int(np.searchsorted(block, block[-1]))
            if end:
                yield rows.slice(0, end)
                rows = rows.slice(end)
                waiting, words = rows.to_batches(), pc.sum(rows["dl"]).as_py() or 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _filled(term: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where new rows begin if successive pieces of a term go together until they hold ``FILL`` postings: ``term`` tells pieces' terms apart."""
    fresh = np.concatenate([[True], term[1:] != term[:-1]])
    before = np.cumsum(size) - size
    share = (before - before[fresh][np.cumsum(fresh) - 1]) // FILL
    return np.flatnonzero(fresh | np.concatenate([[True], share[1:] != share[:-1]]))


def _rows(term: pa.Array, block: np.ndarray, last: np.ndarray, starts: np.ndarray, numbers: np.ndarray, tfs: np.ndarray, dls: np.ndarray) -> pa.RecordBatch:
    """Stored rows whose postings begin at ``starts``."""
    offsets = pa.array(np.append(starts, len(numbers)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (numbers.astype(np.int64), tfs.astype(np.int32), dls.astype(np.int64))]
    most, least = np.maximum.reduceat(tfs, starts), np.minimum.reduceat(dls, starts)
    own = pa.array(last.astype(np.int64), mask=last == block)
    columns = [term, pa.array(block.astype(np.int64)), own, *(pa.array(v) for v in (np.diff(offsets).astype(np.int32), most.astype(np.int32), least.astype(np.int64))), *lists]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in POSTINGS.split(", ")])


def _counted(rows: pa.Table, bits: int) -> pa.RecordBatch | None:
    """Stored rows of ``rows (number, dl, words)``, whose numbers ascend."""
    number, dl = rows["number"].to_numpy(), rows["dl"].to_numpy()
    words = pa.chunked_array([c.flatten() for c in rows["words"].chunks], pa.string()).combine_chunks().dictionary_encode()
    if not len(words):
        return None
    held, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
    term, text = held // len(dl), held % len(dl)
    block = number[text] >> bits
    pieces = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
    starts = pieces[_filled(term[pieces], np.diff(np.append(pieces, len(term))))]
    return _rows(words.dictionary.take(pa.array(term[starts])), block[starts], block[np.append(starts[1:], len(block)) - 1], starts, number[text], tf, dl[text])


def _counting(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches, bits):
            made = _counted(rows, bits)
            if made is not None:
                yield made

    return run


def _flat(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Numbers, counts and lengths of all postings of ``batch``."""
    return [batch.column(c).flatten().to_numpy() for c in ("numbers", "tfs", "dls")]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with successive ones of a term put together while they hold little."""
    for batch in batches:
        if batch.num_rows:
            term, held, block = batch.column("term"), batch.column("held").to_numpy(), batch.column("block").to_numpy()
            starts = _filled(term.dictionary_encode().indices.to_numpy(), held)
            last = pc.coalesce(batch.column("last"), batch.column("block")).to_numpy()
            yield _rows(term.take(pa.array(starts)), block[starts], last[np.append(starts[1:], len(block)) - 1], (np.cumsum(held) - held)[starts], *_flat(batch))


def in_blocks(postings: DataFrame) -> DataFrame:
    """Stored rows with those of several blocks taken apart: a row for each term and block."""
    bits = BLOCK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                numbers, tfs, dls = _flat(batch)
                row, block = np.repeat(np.arange(batch.num_rows), batch.column("held").to_numpy()), numbers >> bits
                starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])]))
                yield _rows(batch.column("term").take(pa.array(row[starts])), block[starts], block[starts], starts, numbers, tfs, dls)

    return postings.select(*[c.split()[0] for c in POSTINGS.split(", ")]).mapInArrow(run, POSTINGS)


def _bounds(postings: DataFrame) -> DataFrame:
    """``(term, block, held, most_tf, least_dl)`` of each block; of rows that hold one block the postings are not read."""
    columns = ["term", "block", "held", "most_tf", "least_dl"]
    return postings.where("last is null").select(*columns).unionByName(in_blocks(postings.where("last is not null")).select(*columns))


def _blocks(counted: DataFrame) -> DataFrame:
    block = F.shiftright("number", BLOCK_BITS).alias("block")
    rows = F.array_sort(F.collect_list(F.struct("number", "tf", "dl")))
    made = counted.groupBy("term", block).agg(F.count(F.lit(1)).cast("int").alias("held"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), rows.alias("r"))
    return made.select("term", "block", F.lit(None).cast("long").alias("last"), "held", "most_tf", "least_dl", F.col("r.number").alias("numbers"), F.col("r.tf").alias("tfs"), F.col("r.dl").alias("dls"))


def in_term_order(postings: DataFrame, files: int) -> DataFrame:
    """Rows in ``files`` ranges of terms, each sorted and put together where they hold little, as they are to be written."""
    return postings.repartitionByRange(max(1, files), "term", "block").sortWithinPartitions("term", "block").mapInArrow(_pack, POSTINGS)


def _opened(postings: DataFrame) -> DataFrame:
    """A row for each posting."""
    return postings.select("term", "block", F.explode(F.arrays_zip("numbers", "tfs", "dls")).alias("p")).select(
        "term", "block", F.col("p.numbers").alias("number"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl")
    )


def without_numbers(postings: DataFrame, dead: DataFrame) -> DataFrame:
    """Postings without the texts in ``dead (number)``; only blocks that hold one of them are taken apart."""
    postings = in_blocks(postings)
    hit = dead.select(F.shiftright("number", BLOCK_BITS).alias("block")).distinct()
    opened = _opened(postings.join(hit, "block", "left_semi")).join(dead.select("number").distinct(), "number", "left_anti")
    return postings.join(hit, "block", "left_anti").select(*postings.columns).unionByName(_blocks(opened.select("term", "number", "dl", "tf")))


def _runs(blocks: list[tuple[str, int]], most: int) -> list[tuple[str, int, int]]:
    """Sorted (term, block) pairs as ``most`` runs (term, first, last) at most if gaps can do it: the smallest gaps are closed."""
    gap = 1
    while True:
        out: list[list] = []
        for term, block in blocks:
            if out and out[-1][0] == term and block - out[-1][2] <= gap:
                out[-1][2] = block
            else:
                out.append([term, block, block])
        if len(out) <= most or gap > 1 << 62:
            return [tuple(r) for r in out]
        gap *= 4


def _narrowed(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Postings in the blocks of ``wanted (term, block)``, block by block. A bounded number of them is named to the scan, so that it skips other pages."""
    few = wanted.limit(SCAN_BLOCKS + 1).collect()
    rows = postings
    if not few:
        return in_blocks(postings.limit(0))
    if len(few) <= SCAN_BLOCKS:
        runs = _runs(sorted((r["term"], r["block"]) for r in few), SCAN_RUNS)
        if len(runs) <= 4 * SCAN_RUNS:
            named = [(F.col("term") == t) & (F.col("block") <= b) & ((F.col("block") >= a) | (F.col("last") >= a)) for t, a, b in runs]
            condition = named[0]
            for c in named[1:]:
                condition = condition | c
            rows = postings.where(condition)
    return in_blocks(rows).join(wanted.select("block").distinct(), "block", "left_semi")


class IndexSearch:
    """Top ``k`` texts for each row of ``queries (query_id, query)`` by BM25, from ``postings`` and ``numbers (id_col, number, dl)`` of the live texts.

    ``dead (number)`` are texts that the postings still hold; they count for nothing. The bounds of a query's terms in a block sum to what no text there exceeds. First the
    blocks with the highest sums are scored, which gives a score that the query's k-th text reaches at least; then those whose sums reach it. Of terms
    that fill blocks only those are read. Texts are put together again by block, so a task scores its own against all queries, as ``WordSearch`` does.
    """

    def __init__(self, postings: DataFrame, numbers: DataFrame, queries: DataFrame, k: int, cfg: Config = Config(), dead: DataFrame | None = None, id_col: str = "chunk_id") -> None:
        self.k, self.cfg, self.id_col, self.numbers = k, cfg, id_col, numbers
        self.spark, self.query_type = queries.sparkSession, queries.schema["query_id"].dataType
        self.asked = cut(queries.select("query_id", F.explode(word_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")))
        terms = self.asked.select("term").distinct()
        some = terms.limit(SCAN_TERMS + 1).collect()
        self.postings = postings.where(F.col("term").isin([r["term"] for r in some])) if len(some) <= SCAN_TERMS else postings.join(terms, "term", "left_semi")
        row = numbers.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
        self.n, self.avgdl = row["n"], row["avgdl"] or 1.0
        #: Blocks of the asked terms without their postings.
        self.blocks = stored(_bounds(self.postings).select("term", "block", "held", self._share("most_tf", "least_dl").alias("bound")), "blocks")
        per_term = self.blocks.groupBy("term").agg(F.sum("held").alias("df"), F.max("bound").alias("top"))
        if dead is not None:
            lost = _opened(in_blocks(self.postings).join(dead.select(F.shiftright("number", BLOCK_BITS).alias("block")).distinct(), "block", "left_semi")).join(dead.select("number"), "number", "left_semi")
            per_term = per_term.join(lost.groupBy("term").agg(F.count(F.lit(1)).alias("lost")), "term", "left").withColumn("df", F.col("df") - F.coalesce("lost", F.lit(0)))
        idf = F.greatest(F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.01))
        known = cut(per_term.select("term", idf.alias("idf"), "top"))
        self.weighed = cut(self.asked.join(known, "term").withColumn("most", F.col("times") * F.col("idf") * F.col("top")))
        self.parts = [self._part(known, *part) for part in coded(queries)]

    def _part(self, known: DataFrame, vocabulary: pa.Array, names: list, query: np.ndarray, term: np.ndarray, times: np.ndarray) -> tuple:
        """The words of some queries with their weights, as ``best_of`` takes them."""
        listed = self.spark.createDataFrame(list(enumerate(vocabulary.to_pylist())), "place int, term string")
        found, rare = known.join(F.broadcast(listed), "term").select("place", "idf").toArrow(), np.zeros(len(vocabulary))
        rare[found["place"].to_numpy()] = found["idf"].to_numpy()
        return vocabulary, names, query, term, times * rare[term]

    def _share(self, tf: str, dl: str) -> Column:
        c = self.cfg
        return F.col(tf) * (c.bm25_k1 + 1) / (F.col(tf) + c.bm25_k1 * (1 - c.bm25_b + c.bm25_b * F.col(dl) / self.avgdl))

    def _texts(self, rows: DataFrame, vocabulary: pa.Array) -> DataFrame:
        """``(id_col, dl, terms, tfs)``: the texts in the blocks of ``rows``, with what they have of ``vocabulary``."""
        shared, id_col = self.spark.sparkContext.broadcast(vocabulary), self.id_col
        kind = self.numbers.schema[id_col].dataType.simpleString()

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by("number")
            number, size = right["number"].to_numpy(), pc.list_value_length(left["numbers"]).to_numpy()
            code = np.repeat(pc.fill_null(pc.index_in(left["term"], value_set=shared.value), -1).to_numpy(), size)
            of, tf = (np.concatenate([c.flatten().to_numpy() for c in left[name].chunks] or [size]) for name in ("numbers", "tfs"))
            text = np.searchsorted(number, of)
            there = code >= 0
            there[there] = (text[there] < len(number)) & (number[np.minimum(text[there], len(number) - 1)] == of[there]) if len(number) else False
            order = np.lexsort((code[there], text[there]))
            text, code, tf = (v[there][order] for v in (text, code, tf))
            used = np.unique(text)
            offsets = pa.array(np.append(np.searchsorted(text, used), len(text)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (code, tf)]
            kept = right.take(pa.array(used))
            return pa.table([kept[id_col], kept["dl"], *lists], [id_col, "dl", "terms", "tfs"])

        group = F.shiftright("number", BLOCK_BITS + GROUP_BITS).alias("group")
        left = rows.select(F.shiftright("block", GROUP_BITS).alias("group"), "term", "numbers", "tfs").groupBy("group")
        return left.cogroup(self.numbers.select(group, "number", id_col, F.col("dl").cast("long").alias("dl")).groupBy("group")).applyInArrow(run, f"`{id_col}` {kind}, dl long, terms array<int>, tfs array<int>")

    def _found(self, taken: DataFrame) -> DataFrame:
        """``(query_id, id_col, score, rank)`` among the texts of the blocks ``taken (block)``, which is materialised."""
        rows = _narrowed(self.postings, self.blocks.join(taken.distinct(), "block", "left_semi").select("term", "block"))
        (k1, b), avgdl = (self.cfg.bm25_k1, self.cfg.bm25_b), self.avgdl
        share = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        parts = ((self._texts(rows, vocabulary), *part, share) for vocabulary, *part in self.parts)
        return best_of(self.spark, parts, self.k, self.query_type, self.numbers.schema[self.id_col])

    def taken(self) -> DataFrame:
        """``(query_id, block)`` that can hold one of the query's best texts."""
        sums = cut(self.weighed.join(self.blocks, "term").groupBy("query_id", "block").agg(F.sum(F.col("times") * F.col("idf") * F.col("bound")).alias("bound")))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        first = sums.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= SEEDS * self.k).select("block")
        least = self._found(cut(first.distinct())).where(F.col("rank") == self.k).select("query_id", (F.col("score") - 1e-8).alias("least"))
        return sums.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("query_id", "block")

    def topk(self) -> DataFrame:
        """``(query_id, id_col, score, rank)`` as ``bm25_topk`` has them."""
        return self._found(cut(self.taken().select("block").distinct())).select("query_id", self.id_col, "score", "rank")


def write_index(texts: DataFrame, path: str, batch: int = 0, files: int | None = None, id_col: str = "chunk_id", text_col: str = "text") -> None:
    """Write ``postings`` and ``numbers`` of ``texts`` under ``path``."""
    spark = texts.sparkSession
    # One pass makes both, so that they have the same numbers whatever task is run again.
    bits, kind = BLOCK_BITS, texts.schema[id_col].dataType.simpleString()
    names = [id_col, "number", "dl", *[c.split()[0] for c in POSTINGS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for rows in _whole_blocks(batches, bits):
            types = types or pa.schema([*(pa.field(n, rows.schema.field(n).type) for n in (id_col, "number", "dl")), *_FIELDS])
            for made in (rows.select([id_col, "number", "dl"]), _counted(rows, bits)):
                if made is not None:
                    yield from pa.table([made[f.name] if f.name in made.schema.names else pa.nulls(made.num_rows, f.type) for f in types], types).combine_chunks().to_batches()

    numbered = number_texts(texts.select(id_col, text_col), batch, id_col, text_col)
    numbered.mapInArrow(run, f"`{id_col}` {kind}, number long, dl long, {POSTINGS}").write.parquet(f"{path}/parts")
    parts = spark.read.parquet(f"{path}/parts")
    parts.where("number is not null").select(*names[:3]).write.parquet(f"{path}/numbers")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_term_order(parts.where("term is not null").select(*names[3:]), files).write.options(**PAGES).parquet(f"{path}/postings")
    delete(spark, f"{path}/parts")


def open_index(path: str, queries: DataFrame, k: int, cfg: Config = Config(), id_col: str = "chunk_id") -> IndexSearch:
    """A search of the index that ``write_index`` left under ``path``."""
    read = queries.sparkSession.read
    return IndexSearch(read.parquet(f"{path}/postings"), read.parquet(f"{path}/numbers"), queries, k, cfg, id_col=id_col)
