"""MinHash near-duplicate groups by a multi-index Hamming join of b-bit signatures.

A document's distinct shingles give a signature of 128 symbols of 8 bits, each the low bits of a minimum; two documents
differ in a symbol with probability 1 - J at most. A pair is a candidate if at most ``distance`` symbols differ, which a pair at
the similarity exceeds once in ten million. By the pigeonhole principle one of ``distance // 2 + 1`` chunks then differs in one symbol
at most, so every document emits for each chunk all its variants with one symbol left out, and candidates meet in a shuffle on the variants.

Documents with equal sets are one node. A variant's members first meet its least node, their pivot, alone; what full sets confirm is
contracted to components. Then members of a pivot that are outside its largest component meet all members of that pivot in blocks of bounded
size, on full sets. That leaves out no pair that could join two components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.llm.batches import column, column_bytes, parts, small_batches
from groundspark.llm.ngrams import BLANK, pieces
from groundspark.operators.components import connected_components
from groundspark.runtime import cut

#: Symbols of a signature, of 8 bits each; how many of them are a column.
SYMBOLS, LANE = 128, 8
#: Chance that a pair just at the similarity is no candidate.
MISS = 1e-7
#: Bits of the broadcast set of keys that several nodes share; shingles of all sets of a block, about.
SHARED_BITS = 1 << 26
BLOCK_SHINGLES = 2 << 20
_LANES = [f"s{k}" for k in range(SYMBOLS // LANE)]
_SIGNATURE = f"struct<{', '.join(f'{c}: long' for c in _LANES)}>"
_ODD = np.random.default_rng(1).integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distance_threshold(similarity: float, miss: float = MISS, symbols: int = SYMBOLS) -> int:
    """The least number of differing symbols that pairs at the similarity exceed with a probability of ``miss`` at most."""
    p, beyond = 1 - similarity, 1.0
    for d in range(symbols + 1):
        beyond -= math.comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
        if beyond <= miss:
            return d
    return symbols


def chunks(distance: int, symbols: int = SYMBOLS) -> list[range]:
    """The signature's symbols in so many chunks that ``distance`` errors leave one chunk with at most one."""
    n = min(distance // 2 + 1, symbols)
    edges = [k * symbols // n for k in range(n + 1)]
    return [range(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def shingle_sets(texts: list[bytes | None], shingle: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``shingle`` words; with fewer words, of all its words as one."""
    held: list[list[np.ndarray]] = [[] for _ in texts]
    words = np.zeros(len(texts), dtype=np.int64)
    for piece in pieces(texts, BLANK, shingle):
        words += np.bincount(piece.owner[piece.fresh], minlength=len(texts))
        owner, start, size = piece.runs(shingle)
        hashes = piece.hashes(start, size)
        edges = np.flatnonzero(np.diff(owner, prepend=-1))
        for i, own in zip(owner[edges].tolist(), np.split(hashes, edges[1:]) if len(edges) else (), strict=True):
            held[i].append(own)
    for i in np.flatnonzero((words > 0) & (words < shingle)).tolist():
        held[i] = [np.array([xxhash.xxh64_intdigest(b" ".join(texts[i].translate(BLANK).split()))], dtype=np.uint64)]
    return [np.unique(np.concatenate(own)) if own else np.zeros(0, dtype=np.uint64) for own in held]


def signature(hashes: np.ndarray) -> np.ndarray:
    """One byte for each of the hash functions: low bits of the mixed minimum over the set."""
    least = np.full(SYMBOLS, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, np.multiply.outer(_ODD, hashes[at : at + 1024]).min(axis=1), out=least)
    least ^= least >> np.uint64(29)
    least *= np.uint64(0xBF58476D1CE4E5B9)
    return (least >> np.uint64(56)).astype(np.uint8)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``(id, mark, n_shingles, digest, sig)`` for every row of ``(id, text, mark)``; equal sets have equal digests."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            sets = shingle_sets(column_bytes(batch, "text"), shingle)
            marks = np.array([signature(s) for s in sets], dtype=np.uint8).reshape(-1, SYMBOLS).view("<i8")
            sig = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(marks[:, k])) for k in range(len(_LANES))], _LANES)
            made = [pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]), sig]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "mark"), *made], ["id", "mark", "n_shingles", "digest", "sig"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, mark long, n_shingles long, digest string, sig {_SIGNATURE}")


def variants(nodes: DataFrame, distance: int, shared: np.ndarray | None = None) -> DataFrame:
    """``(key, node)``: hashes of every chunk with each of its symbols left out; only such whose bit is in ``shared`` (see ``_bits``) if given."""
    places = chunks(distance)
    coefficient = np.random.default_rng(2).integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    tag = np.random.default_rng(3).integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
    given = None if shared is None else nodes.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = column(batch, "sig").flatten()
            symbols = np.stack([f.to_numpy() for f in fields], axis=1).view(np.uint8).astype(np.uint64)
            terms = (symbols + np.uint64(1)) * coefficient
            keys = np.empty((batch.num_rows, SYMBOLS), dtype=np.uint64)
            for chunk in places:
                whole = terms[:, chunk.start : chunk.stop].sum(axis=1, dtype=np.uint64)
                keys[:, chunk.start : chunk.stop] = whole[:, None] - terms[:, chunk.start : chunk.stop]
            keys = (keys ^ tag) * np.uint64(0x9E3779B97F4A7C15)
            keys = (keys ^ (keys >> np.uint64(32))).reshape(-1)
            node = np.repeat(column(batch, "node").to_numpy(), SYMBOLS)
            if given is not None:
                at = keys & np.uint64(64 * len(given.value) - 1)
                held = (given.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                keys, node = keys[held], node[held]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node)], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def _bits(shared: DataFrame) -> np.ndarray:
    """A set of bits, ``SHARED_BITS`` at most, that holds every key of ``shared`` (and some others)."""
    words = 1 << max(8, min(SHARED_BITS, 16 * shared.count()).bit_length() - 7)
    at = F.col("key").bitwiseAND(F.lit(64 * words - 1))
    rows = shared.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(words, dtype=np.uint64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _differing(a: str, b: str) -> Column:
    """Symbols in which two signatures differ: a differing byte's bits are gathered in its lowest."""

    def lane(c: str) -> Column:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        return F.bit_count(x)

    return reduce(add, map(lane, _LANES))


def _could_link(a: str, b: str, percent: int, distance: int) -> Column:
    """Sizes and signatures allow the similarity; ``a`` and ``b`` are sides with ``n_shingles`` and ``sig``."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (_differing(f"{a}.sig", f"{b}.sig") <= distance)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(src, dst)`` whose full sets have the similarity; ``sets`` holds the sets of all nodes in pairs."""
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}")) for c in ("src", "dst"))
    both = pairs.join(one, "src").join(two, "dst")
    shared = F.size(F.array_intersect("_src", "_dst"))
    return both.where(100 * shared >= percent * (F.size("_src") + F.size("_dst") - shared)).select("src", "dst")


def node_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``(node, shingles)`` of the given nodes, from the texts of the rows that stand for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(column_bytes(batch, "text"), shingle)]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.ListArray.from_arrays(offsets, pa.array(values))], ["node", "shingles"])

    wanted = nodes.select("node", F.col("id").alias("_id"), F.col("mark").alias("_mark"))
    rows = docs.join(wanted, docs["id"].eqNullSafe(F.col("_id")) & (docs["mark"] == F.col("_mark")))
    return rows.select("node", "text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _links_across(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between members of a block that join two components: rows with ``one`` set against rows with ``two`` set, on full sets.

    Of links that would join the same components again one is enough.
    """
    if not rows["node"].is_unique:  # a block against itself
        rows = rows.groupby("node", as_index=False).agg({"one": "any", "two": "any", "component": "first", "shingles": "first"})
    sets, sizes = rows["shingles"].tolist(), np.array([len(s) for s in rows["shingles"]])
    component, node, two = rows["component"].to_numpy().copy(), rows["node"].to_numpy(), rows["two"].to_numpy()
    owner = np.repeat(np.arange(len(sets)), sizes)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    holders, begins = owner[order], np.searchsorted(code[order], np.arange(int(code.max()) + 2))
    ends = np.cumsum(sizes)
    found = []
    for i in np.flatnonzero(rows["one"].to_numpy()).tolist():
        own = code[ends[i] - sizes[i] : ends[i]]
        count = begins[own + 1] - begins[own]
        places = np.repeat(begins[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        shared = np.bincount(holders[places], minlength=len(sets))
        near = np.flatnonzero(two & (component != component[i]) & (100 * shared >= percent * (sizes + sizes[i] - shared)))
        for j in near.tolist():
            if component[j] != component[i]:
                found.append((node[i], node[j]))
                component[component == component[j]] = component[i]
    return pd.DataFrame({"src": [a for a, _ in found], "dst": [b for _, b in found]}, dtype=np.int64)


def _across(met: DataFrame, found: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of members outside their pivot's largest component with any member of that pivot, in blocks of about ``BLOCK_SHINGLES``."""
    own = met.select("src", F.col("dst").alias("node")).unionByName(met.select("src", F.col("src").alias("node")).distinct())
    known = own.join(found, "node", "left").select("src", "node", F.coalesce("component", "node").alias("component"))
    held = cut(known.join(nodes.select("node", "n_shingles"), "node"))
    per = held.groupBy("src", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    mixed = per.groupBy("src").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", "n").alias("largest"), F.sum("size").alias("size"))
    # Written first, so that the join shuffles both its sides and a pivot of very many members can be split.
    mixed = cut(mixed.where("parts > 1"))
    blocks = F.ceil(F.col("size") / BLOCK_SHINGLES).cast("int").alias("blocks")
    rows = held.join(mixed.select("src", "largest", blocks), "src").withColumn("other", F.col("component") != F.col("largest"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    place = lambda i, j, one, two: F.struct(i.alias("i"), j.alias("j"), one.alias("one"), two.alias("two"))
    no, yes, all_ = F.lit(False), F.lit(True), F.sequence(F.lit(0), F.col("blocks") - 1)
    ones = F.when(F.col("other"), F.transform(all_, lambda j: place(F.col("at"), j, yes, no))).otherwise(F.array().cast("array<struct<i: int, j: int, one: boolean, two: boolean>>"))
    spread = F.concat(ones, F.transform(all_, lambda i: place(i, F.col("at"), no, yes)))
    dealt = F.when(F.col("blocks") == 1, F.array(place(F.lit(0), F.lit(0), F.col("other"), yes))).otherwise(spread)
    placed = rows.select("src", "node", "component", F.explode(dealt).alias("p")).join(sets, "node")
    tasks = placed.select(F.col("src").alias("pivot"), "p.i", "p.j", "p.one", "p.two", "node", "component", "shingles").groupBy("pivot", "i", "j")
    return tasks.applyInPandas(lambda pdf: _links_across(pdf, percent), "src long, dst long")


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    shingle: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    miss: float = MISS,
) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` for every row of ``docs``.

    Sets of distinct runs of ``shingle`` words (ASCII white space parts words, A-Z count as a-z) link if their intersection has ``percent``
    of a hundred of their union. ``component_id`` is the smallest non-null id among the rows reachable, ``kept`` says that it
    is the row's own. Texts without a word, null ones too, have no shingle and link with nothing, not with each other either.
    Rows with a null id take part; a group of such rows alone has a null component and is kept. Repeated rows share their component. An
    empty table gives no rows. Other columns are not read.
    """
    distance = distance_threshold(percent / 100, miss)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    marked = cut(sketches(slim, shingle))
    first = F.min_by(F.struct("id", "mark", "n_shingles", "sig"), F.struct(F.col("id").isNull(), "id", "mark"))
    grouped = marked.where("n_shingles > 0").groupBy("digest").agg(first.alias("f"))
    nodes = cut(grouped.select("digest", "f.*", F.monotonically_increasing_id().alias("node")))
    # Keys are shuffled once to be counted; only those that may be shared are made again.
    counted = variants(nodes, distance).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
    shared = cut(counted.where("n > 1").select("key", "least"))
    members = variants(nodes, distance, _bits(shared)).join(shared, "key")
    met = cut(members.where("node <> least").select(F.col("least").alias("src"), F.col("node").alias("dst")).distinct())

    facts = nodes.select("node", "n_shingles", "sig")
    stars = met.join(facts.alias("a"), F.col("src") == F.col("a.node")).join(facts.alias("b"), F.col("dst") == F.col("b.node"))
    stars = stars.where(_could_link("a", "b", percent, distance)).select("src", "dst")
    of_members = met.select(F.col("src").alias("node")).unionByName(met.select(F.col("dst").alias("node"))).distinct()
    sets = cut(node_sets(slim, nodes.join(of_members, "node"), shingle))
    links = cut(confirmed(stars, sets, percent))
    found = connected_components(links)
    rest = cut(_across(met, found, nodes, sets, percent))
    component = found if rest.isEmpty() else connected_components(links.unionByName(rest))

    linked = nodes.select("digest", F.col("id").alias("least"), "node").join(component, "node")
    roots = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    # Written first, so that the last join shuffles both its sides and a set of very many copies can be split.
    lookup = cut(linked.join(roots, "component").select("digest", "component_id").unionByName(nodes.join(component, "node", "left_anti").select("digest", F.col("id").alias("component_id"))))
    out = marked.select("id", "n_shingles", "digest").join(lookup, "digest", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
