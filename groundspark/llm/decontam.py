"""Benchmark decontamination with an FM-index over each shard of the training texts.

The benchmark's windows of words are the phrases to find. A shard is a run of documents in a task.
A word that no benchmark item holds ends every match, so a shard's text is cut to the runs
of benchmark words that are as long as the shortest window, with a separator between them. Its suffixes are
sorted by prefix doubling, a wavelet matrix over the Burrows-Wheeler transform gives ranks, all distinct windows are
searched backwards together, their occurrences are located by walking to sampled suffixes, and
the hit words of each document are merged into removal spans. Documents never leave their task, so
a passage that many documents share makes no hot key.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.batches import column, column_bytes, gathered, small_batches
from groundspark.runtime import cut

#: Bytes of benchmark text whose windows are broadcast at once; more is done block by block.
BLOCK_BYTES = 8 << 20
#: Windows that are searched, and occurrences that are located, at once.
WINDOWS = 1 << 16
OCCURRENCES = 1 << 18
#: Bytes of documents in one index, about; every eighth suffix keeps its place.
SHARD_BYTES = 16 << 20
SAMPLE = 8
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all characters beyond ASCII."""
    return (text or b"").translate(_FOLD).split()


class WaveletMatrix:
    """Ranks of any symbol below ``1 << bits`` in a sequence."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            one = (symbols >> b) & 1
            ones = np.concatenate([[0], np.cumsum(one, dtype=np.int32)]).astype(np.int32)
            self.levels.append((ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[one == 0], symbols[one == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``, for arrays of both."""
        start, at = np.zeros_like(at), at.copy()
        for level, (ones, zeros) in enumerate(self.levels):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            start = np.where(bit, zeros + ones[start], start - ones[start])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return at - start

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the places ``at``."""
        out, at = np.zeros_like(at), at.copy()
        for ones, zeros in self.levels:
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` in order, by prefix doubling."""
    n, rank, step = len(s), s.astype(np.int64), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Finds phrases in a sequence of symbols from 0; inside, they are one higher, as 0 marks the end."""

    def __init__(self, s: np.ndarray) -> None:
        s = np.concatenate([s + 1, [0]]).astype(np.int64)
        order = suffix_array(s)
        bwt = s[order - 1]
        self.n, self.bits = len(s), max(1, int(s.max()).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << self.bits))])
        self.wavelet = WaveletMatrix(bwt, self.bits)
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.cumsum(self.sampled) - self.sampled
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases (one a row, all of one length), searched backwards together."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j] + 1
            known = c < (1 << self.bits)
            high[alive[~known]] = low[alive[~known]]
            alive, c = alive[known], c[known]
            low[alive] = self.before[c] + self.wavelet.rank(c, low[alive])
            high[alive] = self.before[c] + self.wavelet.rank(c, high[alive])
            alive = alive[high[alive] > low[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the sequence the suffixes of ``rows`` start."""
        out, steps, left, at = np.zeros(len(rows), dtype=np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(left):
            there = self.sampled[at]
            out[left[there]] = self.samples[self.sample_rank[at[there]]] + steps
            left, at, steps = left[~there], at[~there], steps + 1
            c = self.wavelet.symbol(at)
            at = self.before[c] + self.wavelet.rank(c, at)
        return out


class Phrases:
    """Windows of a block of benchmark items: word ids by word, the items' words in one array, and the windows in it by length.

    A window is only a place in that array, so what is built and broadcast stays about as large as the text.
    """

    def __init__(self, items: Iterable[tuple[object, bytes | None]], window: int) -> None:
        self.words: dict[bytes, int] = {}
        self.items: list[str | None] = []
        sequence, stops = array("i"), []
        for item, text in items:
            sequence.extend(self.words.setdefault(w, len(self.words) + 1) for w in words_of(text))
            stops.append(len(sequence))
            self.items.append(None if item is None else str(item))
        self.sequence, self.stops = np.array(sequence, dtype=np.int32), np.array(stops, dtype=np.int64)
        sizes = np.diff(self.stops, prepend=0)
        #: Lengths of windows, rising.
        self.lengths = np.unique(np.minimum(sizes[sizes > 0], window)).tolist()
        self.window = window
        self._distinct: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @property
    def shortest(self) -> int:
        return min(self.lengths, default=0)

    def distinct(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct windows of one length: where each begins, and as ``owners[offsets[k]:offsets[k + 1]]`` its items. Made once in a process."""
        if length not in self._distinct:
            sizes = np.diff(self.stops, prepend=0)
            item = np.flatnonzero(sizes >= length if length == self.window else sizes == length)
            count = sizes[item] - length + 1
            owner = np.repeat(item, count)
            start = np.repeat(self.stops[item] - sizes[item] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            _, first, name = np.unique(_names(self.sequence, length)[start], return_index=True, return_inverse=True)
            pairs = np.unique(name.astype(np.int64) * len(sizes) + owner)
            offsets = np.searchsorted(pairs, np.arange(len(first) + 1) * len(sizes))
            self._distinct[length] = start[first], offsets, pairs % len(sizes)
        return self._distinct[length]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_distinct": {}}


def _names(sequence: np.ndarray, length: int) -> np.ndarray:
    """A number for the ``length`` symbols from each place on, equal where they are equal (places near the end have none of worth)."""
    name, size = sequence.astype(np.int64), 1
    while size < length:
        step = min(size, length - size)
        after = np.concatenate([name[step:], np.zeros(min(step, len(name)), dtype=np.int64)])
        name = np.unique(name * (int(name.max(initial=0)) + 1) + after, return_inverse=True)[1]
        size += step
    return name


def _runs(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-zero ids that have ``shortest`` at least."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids != 0).astype(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    long = end - start >= shortest
    return start[long], end[long]


def find_hits(texts: list[bytes | None], phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Word counts, merged spans of hit words (start, end) and hit items of each text of a shard."""
    n_words, spans, items = [], [[] for _ in texts], [set() for _ in texts]
    shortest = phrases.shortest
    parts, docs, starts, at = [], [], [], 0
    begins = []
    for i, text in enumerate(texts):
        words = words_of(text)
        n_words.append(len(words))
        if not shortest or len(words) < shortest:
            continue
        ids = np.fromiter(map(phrases.words.get, words, repeat(0)), dtype=np.int64, count=len(words))
        for a, b in zip(*_runs(ids, shortest), strict=True):
            parts += [ids[a:b], [0]]
            docs.append(i)
            starts.append(a)
            begins.append(at)
            at += b - a + 1
    if not parts:
        return n_words, spans, items
    sequence = np.concatenate(parts).astype(np.int64)
    # The shard's own alphabet, dense, so that the wavelet matrix has few levels.
    alphabet = np.unique(np.concatenate([[0], sequence]))
    dense = np.full(len(phrases.words) + 2, 1 << 62, dtype=np.int64)
    dense[alphabet] = np.arange(len(alphabet))
    index = FMIndex(dense[sequence])
    docs, starts, begins = map(np.array, (docs, starts, begins))
    cover = np.zeros(at + 1, dtype=np.int64)
    hits = []
    for size in phrases.lengths:
        begin, offsets, owners = phrases.distinct(size)
        for lot in range(0, len(begin), WINDOWS):
            low, high = index.search(dense[phrases.sequence[begin[lot : lot + WINDOWS, None] + np.arange(size)]])
            count = np.maximum(high - low, 0)
            # Distinct windows of one length have disjoint ranges, so all their occurrences are no more than the text has places.
            ends = np.cumsum(count)
            for at in range(0, int(ends[-1]), OCCURRENCES):
                rows = np.arange(at, min(at + OCCURRENCES, int(ends[-1])))
                which = np.searchsorted(ends, rows, side="right")
                place = index.locate(rows - (ends[which] - count[which]) + low[which])
                cover[place] += 1
                np.subtract.at(cover, place + size, 1)
                run = np.searchsorted(begins, place, side="right") - 1
                pairs = np.unique(docs[run] * len(begin) + which + lot)
                doc, window = pairs // len(begin), pairs % len(begin)
                own = offsets[window + 1] - offsets[window]
                nth = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
                item = owners[np.repeat(offsets[window], own) + nth]
                hits.append(np.unique(np.repeat(doc, own) * len(phrases.items) + item))
    covered = (np.cumsum(cover[:-1]) > 0).astype(np.int64)
    for a, b in zip(*_runs(covered, 1), strict=True):
        r = int(np.searchsorted(begins, a, side="right")) - 1
        shift = int(starts[r] - begins[r])
        spans[int(docs[r])].append((int(a) + shift, int(b) + shift))
    for pair in np.unique(np.concatenate(hits)).tolist() if hits else ():
        i, k = divmod(pair, len(phrases.items))
        if phrases.items[k] is not None:
            items[i].add(phrases.items[k])
    return n_words, spans, items


def _merge(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(old + new):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = "array<struct<start: int, end: int>>"


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (by default all) with ``n_words``, ``n_hit``, ``spans``, ``items`` and ``contaminated``.

    A window is ``window`` consecutive words of a benchmark item, or all words of a shorter
    one. ``spans`` are the merged word ranges inside occurrences of windows, ``items`` the sorted ids (as
    strings) of the items that they come from; ``contaminated`` says that a twentieth of the words is hit.
    Null and empty texts have no words, items without words no window; items with a null id hit
    words but aren't listed, and rows that repeat an item count once. Of columns with the new names, the
    old ones give way.
    """
    small_batches(docs.sparkSession)
    new = ["n_words", "n_hit", "spans", "items", "contaminated"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    items = benchmark.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    sizes = items.select("item", "text", (F.octet_length("text") + 64).alias("b"))
    total = sizes.agg(F.sum("b")).first()[0] or 0
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    out = docs.select(*keep, F.col(text_col).alias("_text"), F.expr(f"cast(array() as {_SPANS})").alias("_spans"), F.expr("cast(array() as array<string>)").alias("_items"))
    if total <= block_bytes:
        blocks = [items]
    else:
        n = -(-total // (block_bytes // 2))
        dealt = sizes.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
        blocks = [dealt.where(F.col("block") == k) for k in range(n)]
    for k, block in enumerate(blocks):
        rows = ((r["item"], r["text"].encode()) for r in block.select("item", "text").toLocalIterator())
        shared = docs.sparkSession.sparkContext.broadcast(Phrases(rows, window))
        out = out.mapInArrow(_finder(shared, keep), f"{fields}_text string, _n_words int, _spans {_SPANS}, _items array<string>")
        if k + 1 < len(blocks):
            out = cut(out)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return out.select(
        *keep, F.col("_n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.col("_spans").alias("spans"), F.array_sort("_items").alias("items")
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def _finder(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "_text", SHARD_BYTES):
            n_words, spans, items = find_hits(column_bytes(batch, "_text"), shared.value)
            before = [[(x["start"], x["end"]) for x in row] if row else [] for row in column(batch, "_spans").to_pylist()]
            listed = column(batch, "_items").to_pylist()
            spans = [_merge(a, b) if a else b for a, b in zip(before, spans, strict=True)]
            rows = [sorted({*(a or ()), *b}) for a, b in zip(listed, items, strict=True)]
            kept = [batch.column(i) for i in range(len(keep))]
            made = [
                column(batch, "_text"), pa.array(n_words, pa.int32()),
                pa.array([[{"start": a, "end": b} for a, b in own] for own in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array(rows, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*keep, "_text", "_n_words", "_spans", "_items"])

    return run
