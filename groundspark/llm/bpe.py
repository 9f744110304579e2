"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last one of the prefix's encoding: the
token that ends there and forms a valid pair with the last token of what is before it. Storing that token for
every prefix gives the encoding by walking back from the end, lets bytes be appended without
looking at what came before again, and after an edit needs only the prefixes near it.

A pair is valid if merging its bytes gives exactly the pair. That is read off how both tokens are made: their merges next
to the border are undone, latest first, and no two parts that meet there may form a token which would have been merged earlier.

The distinct pieces of a block of texts are worked on together, one prefix length after the other, in numpy; long pieces
and texts that grow or change go the same way byte by byte. The vocabulary file is read on the driver and broadcast
(its size is checked); it is never trained.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.batches import column, parts, slices, small_batches

MAX_VOCABULARY_BYTES = 64 << 20
#: Distinct pieces whose tokens a task remembers, pairs whose check it does, and tokens that are decoded at once.
CACHE_PIECES = 200_000
CACHE_PAIRS = 50_000
DECODE_TOKENS = 1 << 19
#: Pieces that are looked up at once, characters of text that are split at once, bytes of a piece that goes the vector way and of pieces that do so together.
BLOCK_PIECES = 160_000
BLOCK_CHARS = 1 << 20
SHORT_BYTES = 48
LOT_BYTES = 200_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """From lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def byte_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes by id, where each starts, and how many it has (0: no such id)."""
    order = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        order[i] = token
    lengths = np.fromiter(map(len, order), dtype=np.int64, count=len(order))
    return np.frombuffer(b"".join(order), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


class Lookup:
    """Values (0 or more) of distinct keys, found for whole arrays at once; -1 for other keys.

    A hash table in levels: of keys that share a slot one stays, the others go to the next level.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.levels = []
        while len(keys):
            bits = max(4, (2 * len(keys)).bit_length())
            slot = self._slot(keys, bits)
            _, first = np.unique(slot, return_index=True)
            held, at = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
            held[slot[first]], at[slot[first]] = keys[first], values[first]
            self.levels.append((held, at, bits))
            keys, values = np.delete(keys, first), np.delete(values, first)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, dtype=np.int64), None
        for held, values, bits in self.levels:
            slot = self._slot(keys, bits)
            there = held[slot]
            hit = there == keys
            out[hit if left is None else left[hit]] = values[slot[hit]]
            more = np.flatnonzero(~hit & (there >= 0))
            if not len(more):
                break
            left, keys = more if left is None else left[more], keys[more]
        return out


class Vocabulary:
    """Ranks of byte strings, the tokens within a text, and the check of token pairs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.by_id = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.size = max(ranks.values(), default=0) + 1
        #: Rank of what two tokens are together, by left * size + right.
        self.joined: dict[int, int] = {}
        #: Parts from which merging makes a token, and the rank of that merge (-1: a single byte).
        self.left, self.right, self.made = [-1] * self.size, [-1] * self.size, [-1] * self.size
        self.pair = lru_cache(CACHE_PAIRS)(self._pair)
        reached = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if self._split(t)]
        self._arrays(reached)
        self.pieces = Pieces(self)

    @classmethod
    def from_file_bytes(cls, data: bytes) -> Vocabulary:
        return cls(read_ranks(data))

    @cached_property
    def endings(self) -> ahocorasick.Automaton:
        """Finds the tokens that end at each byte, for texts that go byte by byte."""
        found = ahocorasick.Automaton()
        for i in np.flatnonzero(self._sizes).tolist():
            found.add_word(self.by_id[i].decode("latin-1"), (len(self.by_id[i]), i))
        found.make_automaton()
        return found

    def _split(self, token: bytes) -> bool:
        """Note the parts of a token, those of lower rank being known; False if merging never makes it.

        A file in which merging makes a token from parts of higher rank is an error.
        """
        i, found = self.ranks[token], len(token) == 1
        for at in range(1, len(token)):
            a, b = self.ranks.get(token[:at]), self.ranks.get(token[at:])
            if a is None or b is None:
                continue
            self.joined[a * self.size + b] = i
            known = all(x < i and self.left[x] >= 0 or len(self.by_id[x]) == 1 for x in (a, b))
            if not found and known and self._pair(a, b, i):
                self.left[i], self.right[i], self.made[i], found = a, b, i, True
        if not found and self.merge(token) == [i]:
            raise ValueError("the ranks are not in the order of merges")
        return found

    def _arrays(self, reached: list[bytes]) -> None:
        """The same tables for whole arrays, and a trie of the tokens that merging makes."""
        keys = np.fromiter(self.joined, dtype=np.int64, count=len(self.joined))
        self._joined = Lookup(keys, np.fromiter(self.joined.values(), dtype=np.int64, count=len(keys)))
        self._left, self._right, self._made = (np.array(x, dtype=np.int64) for x in (self.left, self.right, self.made))
        self._sizes = np.zeros(self.size, dtype=np.int64)
        sizes = np.fromiter(map(len, reached), dtype=np.int64, count=len(reached))
        ids = np.fromiter(map(self.ranks.get, reached), dtype=np.int64, count=len(reached))
        self._sizes[ids] = sizes
        data, starts = np.frombuffer(b"".join(reached), dtype=np.uint8), np.cumsum(sizes) - sizes
        at, node, nodes, keys = np.arange(len(reached)), np.zeros(len(reached), dtype=np.int64), 1, []
        for depth in range(self.longest):
            at = at[sizes[at] > depth]
            new, which = np.unique(node[at] * 256 + data[starts[at] + depth], return_inverse=True)
            node[at] = nodes + which
            keys.append(new)
            nodes += len(new)
        #: Children by node * 256 + byte, node 0 being the root, and the token at each node (-1: none).
        self._child = Lookup(np.concatenate(keys) if keys else np.zeros(0, np.int64), np.arange(1, nodes))
        self._token = np.full(nodes, -1, dtype=np.int64)
        self._token[node] = ids

    def merge(self, text: bytes) -> list[int]:
        """Merge by ranks, lowest first and leftmost of equals, until no neighbours form a token."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _pair(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether merging the bytes of both tokens, with ranks under ``limit``, gives just them.

        Of the merges that made the two the later one is undone (of equal ranks the left one came first), until both are single
        bytes; ``limit`` says which ranks came before what was undone last.
        """
        while self.joined.get(left * self.size + right, limit) >= limit:
            a, b = self.made[left], self.made[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.right[left]
            else:
                limit, right = b + 1, self.left[right]
        return False

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``pair`` of whole arrays."""
        valid, at, limit = np.zeros(len(left), dtype=bool), np.arange(len(left)), np.full(len(left), 1 << 60)
        while len(at):
            joint = self._joined.find(left * self.size + right)
            a, b = self._made[left], self._made[right]
            free = (joint < 0) | (joint >= limit)
            valid[at[free & (a < 0) & (b < 0)]] = True
            on = np.flatnonzero(free & ((a >= 0) | (b >= 0)))
            at, a, b, left, right = at[on], a[on], b[on], left[on], right[on]
            undo = a > b
            limit = np.where(undo, a, b + 1)
            left, right = np.where(undo, self._right[left], left), np.where(undo, right, self._left[right])
        return valid

    def extend(self, text: bytes, last: list[int]) -> None:
        """Append to ``last`` the last token of each further prefix of ``text``."""
        done, pair = len(last), self.pair
        for at, (size, token) in self.endings.iter(text.decode("latin-1"), max(0, done - self.longest)):
            if at == done and (at < size or pair(last[at - size], token)):  # else before the new prefixes, or settled
                last.append(token)
                done += 1
        if done < len(text):
            raise ValueError("the vocabulary lacks a byte")

    def encode_together(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all of ``texts`` (not empty, neither long) in a row, and how many each has."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        data, stops = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum(sizes)
        starts, stop_of = stops - sizes, np.repeat(stops, sizes)
        at, node, depth, found = np.arange(len(data)), np.zeros(len(data), dtype=np.int64), 0, []
        while len(at):
            node = self._child.find(node * 256 + data[at + depth])
            at, node = at[node >= 0], node[node >= 0]
            token = self._token[node]
            some = np.flatnonzero(token >= 0)
            found.append(((at[some] + depth).astype(np.int32), token[some].astype(np.int32), np.full(len(some), depth + 1, dtype=np.int32)))
            depth += 1
            more = at + depth < stop_of[at]
            at, node = at[more], node[more]
        end, token, size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32),) * 3
        place = (end - np.repeat(starts, sizes)[end]).astype(np.int16)
        order = np.argsort(place, kind="stable")
        end, token, size = end[order], token[order], size[order]
        bounds = np.searchsorted(place[order], np.arange(int(sizes.max(initial=0)) + 1))
        last = np.full(len(data), -1, dtype=np.int64)
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            e, t, n = end[a:b], token[a:b], size[a:b]
            valid = n == k + 1  # from the start on
            inner = np.flatnonzero(~valid)
            before = last[e[inner] - n[inner]]
            inner, before = inner[before >= 0], before[before >= 0]
            valid[inner] = self.pairs(before, t[inner].astype(np.int64))
            last[e[valid]] = t[valid]
        if (last < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        at, which, steps = stops - 1, np.arange(len(texts)), []
        counts = np.zeros(len(texts), dtype=np.int64)
        while len(at):
            token = last[at]
            steps.append((which, token))
            counts[which] += 1
            at = at - self._sizes[token]
            more = at >= starts[which]
            at, which = at[more], which[more]
        out, ends = np.empty(int(counts.sum()), dtype=np.int32), np.cumsum(counts)
        for back, (which, token) in enumerate(steps, start=1):
            out[ends[which] - back] = token
        return out, counts

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all of ``texts`` in a row, and how many each has; a text that is a token is that token."""
        tokens = [None] * len(texts)
        short = []
        for i, text in enumerate(texts):
            whole = self.ranks.get(text)
            if whole is not None:
                tokens[i] = (whole,)
            elif len(text) > SHORT_BYTES or not text:
                tokens[i] = Prefixes(self, text).tokens()
            else:
                short.append(i)
        lots = [self.encode_together([texts[i] for i in short[a:b]]) for a, b in slices([len(texts[i]) for i in short], LOT_BYTES)]
        row = np.concatenate([x for x, _ in lots] or [np.zeros(0, dtype=np.int32)])
        counts = np.concatenate([x for _, x in lots] or [np.zeros(0, dtype=np.int64)])
        n = np.fromiter((0 if t is None else len(t) for t in tokens), dtype=np.int64, count=len(texts))
        n[short] = counts
        starts = np.cumsum(n) - n
        out = np.empty(int(n.sum()), dtype=np.int32)
        out[np.repeat(starts[short] - (np.cumsum(counts) - counts), counts) + np.arange(len(row))] = row
        for i, t in enumerate(tokens):
            if t is not None:
                out[starts[i] : starts[i] + len(t)] = t
        return out, n


class Pieces:
    """Tokens of pieces met before, in one array; when it is full, the pieces at hand start a new one."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self._restart()

    def _restart(self) -> None:
        self.number: dict[str, int] = {}
        self.tokens, self.stops = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces in a row, and how many each has."""
        distinct = set(pieces)
        new = [p for p in distinct if p not in self.number]
        if new and len(self.number) + len(new) > CACHE_PIECES:
            self._restart()
            new = list(distinct)
        if new:
            tokens, counts = self.vocabulary.encode_all([p.encode() for p in new])
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.stops = np.concatenate([self.stops, len(self.tokens) + np.cumsum(counts)])
            self.tokens = np.concatenate([self.tokens, tokens])
        at = np.fromiter(map(self.number.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        counts = np.diff(self.stops, prepend=0)[at]
        where = np.repeat(self.stops[at] - np.cumsum(counts), counts) + np.arange(int(counts.sum()))
        return self.tokens[where], counts


def encode_texts(vocabulary: Vocabulary, texts: list[str | None], split: Callable[[str], Iterator[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts in a row, and how many each has; ``split`` yields a text's pieces in blocks."""
    sizes, out, held, marks = np.zeros(len(texts), dtype=np.int64), [np.zeros(0, dtype=np.int32)], [], []

    def flush() -> None:
        tokens, counts = vocabulary.pieces.encode(held)
        out.append(tokens)
        rows, n = np.array(marks, dtype=np.int64).reshape(-1, 2).T
        np.add.at(sizes, rows, np.diff(np.concatenate([[0], np.cumsum(counts)])[np.cumsum(n)], prepend=0))
        held.clear()
        marks.clear()

    for row, text in enumerate(texts):
        for block in split(text) if text else ():
            held += block
            marks.append((row, len(block)))
            if len(held) >= BLOCK_PIECES:
                flush()
    flush()
    return np.concatenate(out), sizes


def splitter(pattern: str) -> Callable[[str], Iterator[list[str]]]:
    """Yields the matches of a pattern in a text, those of a very long text in blocks."""
    slow = regex.compile(pattern)
    quick = ascii_pattern(pattern) or slow

    def split(text: str) -> Iterator[list[str]]:
        rule = quick if text.isascii() else slow
        if len(text) <= BLOCK_CHARS:
            yield rule.findall(text)
            return
        found = rule.finditer(text)
        while block := [m[0] for m in islice(found, BLOCK_PIECES)]:
            yield block

    return split


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for ASCII text in the quicker standard engine; None if it isn't one that translates."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        two, four = pattern[i : i + 2], pattern[i : i + 5]
        if four in _ASCII:
            out += _ASCII[four] if inside else f"[{_ASCII[four]}]"
            i += 5
        elif two[:1] == "\\":
            if two not in ("\\s", "\\S"):
                return None
            out += two
            i += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out += two[0]
            i += 1
    return re.compile(out, re.ASCII)


#: What the classes of letters and numbers are within ASCII.
_ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}


class Prefixes:
    """Last tokens of all prefixes of a byte string that can grow and change."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b"") -> None:
        self.vocabulary, self.text, self.last = vocabulary, b"", []
        self.append(text)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; only their own prefixes are computed."""
        self.text += more
        self.vocabulary.extend(self.text, self.last)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace ``text[start:stop]``; returns how many prefixes had to be computed.

        A prefix's last token depends on the bytes and last tokens within the length of the longest token
        before its end. Once that many prefixes in a row agree with the old ones, all later ones do.
        """
        span, old_tail, tail = self.vocabulary.longest, self.last[stop:], self.text[stop:]
        self.text, self.last = self.text[:start] + new + tail, self.last[:start]
        for at in range(0, len(tail), span):
            self.vocabulary.extend(self.text[: start + len(new) + min(at + span, len(tail))], self.last)
            if len(tail) - at > span and self.last[-span:] == old_tail[at : at + span]:
                self.last += old_tail[at + span :]
                return len(new) + at + span
        self.vocabulary.extend(self.text, self.last)
        return len(self.text) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.text)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.by_id[out[-1]])
        return out[::-1]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is over {MAX_VOCABULARY_BYTES} bytes")
    return data


def _shared(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))


@lru_cache(1)
def _loaded(data: bytes) -> Vocabulary:
    """The vocabulary of a file's bytes, kept for the tasks that a worker runs later."""
    return Vocabulary.from_file_bytes(data)


@lru_cache(1)
def _table(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in a file, kept in the same way for tasks that decode."""
    return byte_table(read_ranks(data))


def expand(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids in a row, and the number of bytes of each."""
    data, starts, lengths = table
    if len(ids) and (ids.min() < 0 or ids.max() >= len(lengths) or not lengths[ids].all()):
        raise ValueError("an id is outside the vocabulary")
    n = lengths[ids]
    at = np.arange(int(n.sum()), dtype=np.int64) + np.repeat(starts[ids] - (np.cumsum(n) - n), n)
    return data[at], n


def decoded(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, pa.Array]]:
    """Bytes of rows of ``sizes`` ids each, as binary arrays for runs of rows (first, end) of bounded size."""
    ends = np.cumsum(sizes)
    for start, stop in slices(sizes.tolist(), DECODE_TOKENS):
        first = int(ends[start] - sizes[start])
        data, lengths = expand(table, ids[first : ends[stop - 1]])
        before = np.concatenate([[0], np.cumsum(lengths)])
        offsets = before[np.concatenate([[0], ends[start:stop] - first])].astype(np.int32)
        yield start, stop, pa.Array.from_buffers(pa.binary(), stop - start, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _fields(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema.fields)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, tokens_col: str = "tokens", bytes_col: str | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (by default all) with ``tokens_col``, an array of ids.

    Each match of ``pattern`` is encoded separately by the ranks in the file at ``path``; text between matches, if
    the pattern leaves any, has no tokens. Null and empty texts have an empty array. With ``bytes_col`` the ids are also
    decoded in the same task, as ``decode`` does in a later one. Existing columns of the new names give way.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (tokens_col, bytes_col)]
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split = _loaded(shared.value), splitter(pattern)
        for batch in parts(batches, "_text"):
            values, sizes = encode_texts(vocabulary, column(batch, "_text").to_pylist(), split)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            kept = [batch.column(i) for i in range(len(keep))]
            made, names = [pa.ListArray.from_arrays(offsets, pa.array(values))], [*keep, tokens_col]
            if bytes_col is not None:
                back = [x for _, _, x in decoded(_table(shared.value), values, sizes)]
                made.append(pa.concat_arrays(back) if back else pa.array([], pa.binary()))
                names.append(bytes_col)
            yield pa.RecordBatch.from_arrays([*kept, *made], names)

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, f"{_fields(docs, keep)}`{tokens_col}` array<int>" + (f", `{bytes_col}` binary" if bytes_col is not None else ""))


def decode(encoded: DataFrame, path: str, tokens_col: str = "tokens", keep: list[str] | None = None, bytes_col: str = "decoded") -> DataFrame:
    """Columns ``keep`` of ``encoded`` (by default all) with ``bytes_col``, the bytes that the ids stand for.

    A null or empty array gives empty bytes; an id outside the vocabulary is an error.
    """
    small_batches(encoded.sparkSession)
    keep = [c for c in (encoded.columns if keep is None else keep) if c != bytes_col]
    shared = _shared(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared.value)
        for batch in batches:
            lists = column(batch, "_tokens")
            for start, stop, made in decoded(table, lists.flatten().to_numpy(), pc.fill_null(lists.value_lengths(), 0).to_numpy()):
                kept = [batch.column(i).slice(start, stop - start) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, made], [*keep, bytes_col])

    return encoded.select(*keep, F.col(tokens_col).alias("_tokens")).mapInArrow(run, f"{_fields(encoded, keep)}`{bytes_col}` binary")
