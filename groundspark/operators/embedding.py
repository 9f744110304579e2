"""Hashed feature embeddings, row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from groundspark.functions.providers import guarded
from groundspark.functions.text import STOP_WORDS, word_tokens
from groundspark.operators.vectors import unit
from groundspark.runtime import cut

_STOP = frozenset(STOP_WORDS)
#: The space of hashed features.
LOCAL = "local"
#: Words, and numbers of vectors, that a task works on at once, about.
PART_WORDS, PART_CELLS = 1 << 18, 1 << 20


def bucket_sign(feature: Column, salt: int | Column, dim: int) -> tuple[Column, Column]:
    """Bucket (128-bit MD5 of ``feature:salt`` modulo ``dim``) and sign (+1 if bit 31 is set, else -1)."""
    salt = F.lit(salt) if isinstance(salt, int) else salt
    digest = F.md5(F.concat(feature, F.lit(":"), salt.cast("string")))
    word = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    rest = word(0) % dim
    for k in (1, 2, 3):
        rest = (rest * ((1 << 32) % dim) + word(k)) % dim
    return rest.cast("int"), F.when(F.substring(digest, 25, 1) >= "8", 1.0).otherwise(-1.0)


def _hashed(features: list[str], salt: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and signs of strings, as ``bucket_sign`` has them."""
    end = f":{salt}".encode()
    digests = b"".join([md5(f.encode() + end, usedforsecurity=False).digest() for f in features])
    words = np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)
    rest = words[:, 0] % dim
    for k in (1, 2, 3):
        rest = (rest * ((1 << 32) % dim) + words[:, k]) % dim
    return rest, np.where(words[:, 3] >> 31, 1.0, -1.0)


def _vectors(words: pa.ListArray, dim: int) -> np.ndarray:
    """A row of unit length for each list of words: words, character 3- and 4-grams and word pairs, hashed and summed.

    Each distinct word, gram and pair of the batch is hashed once. Rows without words, or whose features cancel, are uniform.
    """
    rows, lengths = len(words), pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    coded = words.flatten().dictionary_encode()
    vocab, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    doc = np.repeat(np.arange(rows), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    stop, n = np.array([w in _STOP for w in vocab], bool), max(1, len(vocab))
    out = np.zeros(rows * dim)

    def add(where: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> None:
        np.add(out, np.bincount(where * dim + bucket, value, rows * dim), out=out)

    bucket, sign = _hashed(vocab, 1, dim)
    add(doc, bucket[codes], sign[codes] * np.where(stop[codes], 0.2, 1.0) * (1 + 1 / (place + 1)))

    held, times = np.unique(doc * n + codes, return_counts=True)
    for size in (3, 4):
        grams = [[] if s else [w[k : k + size] for k in range(len(w) - size + 1)] for w, s in zip(vocab, stop)]
        counts = np.array([len(g) for g in grams], np.int64)
        # Words share most of their grams.
        listed = pa.array(list(chain.from_iterable(grams)), pa.string()).dictionary_encode()
        bucket, sign = (h[listed.indices.to_numpy()] for h in _hashed(listed.dictionary.to_pylist(), size, dim))
        many = counts[held % n]
        at = np.arange(many.sum()) + np.repeat((np.cumsum(counts) - counts)[held % n] - (np.cumsum(many) - many), many)
        add(np.repeat(held // n, many), bucket[at], sign[at] * np.repeat(times * 0.35, many))

    paired = (doc[1:] == doc[:-1]) & ~(stop[codes[1:]] & stop[codes[:-1]])
    pairs, inverse = np.unique(codes[:-1][paired].astype(np.int64) * n + codes[1:][paired], return_inverse=True)
    bucket, sign = _hashed([f"{vocab[p // n]}_{vocab[p % n]}" for p in pairs.tolist()], 7, dim)
    add(doc[1:][paired], bucket[inverse], sign[inverse] * 0.75)

    made = out.reshape(rows, dim)
    norm = np.sqrt((made * made).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-9, made / np.where(norm > 1e-9, norm, 1), dim**-0.5)


def _embed_batches(batches: Iterator[pa.RecordBatch], id_col: str, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
        # A part ends where its words, or its vectors, fill their share; a long text is a part of its own.
        share = np.cumsum(sizes / PART_WORDS + dim / PART_CELLS).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(sizes)]
        for start, stop in zip(cuts, cuts[1:]):
            part = batch.slice(start, stop - start)
            made = _vectors(part.column(1), dim)
            offsets = pa.array(np.arange(0, made.size + 1, dim), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))], [id_col, "embedding"])


def sparse_embed(texts: DataFrame, dim: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id_col, bucket, value)`` of unit length without zeros; texts without tokens, or whose features cancel, are uniform."""
    return embed(texts, dim, id_col, text_col).select(id_col, F.posexplode("embedding").alias("bucket", "value")).where("value <> 0")


def embed(texts: DataFrame, dim: int, id_col: str = "id", text_col: str = "text", provider: Callable | None = None, space: str | None = None) -> DataFrame:
    """``(id_col, embedding array<double>)``, a row for each row of ``texts`` (null texts have no words).

    Every vector comes from its own row, so nothing is shuffled. ``provider``, a ``mapInPandas`` function over (id, text) batches that yields (id, embedding), takes
    the place of the hashed features; its vectors are scaled to unit length, and such of another length than ``dim`` are an error.
    Batches on which it raises get hashed features. With ``space``, a name for the provider's vectors, a column ``space`` tells the two kinds apart: it
    holds that name, or ``LOCAL`` for hashed features.
    """
    id_type = texts.schema[id_col].dataType.simpleString()
    if provider is not None:
        name = space or "remote"

        def local(batch: pd.DataFrame) -> pd.DataFrame:
            return batch[[id_col]].assign(embedding=list(_vectors(pa.array(batch["words"], pa.list_(pa.string())), dim)), space=LOCAL)

        def remote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for made in provider(batches):
                yield made[[id_col, "embedding"]].assign(space=name)

        listed = texts.select(id_col, text_col, word_tokens(F.col(text_col)).alias("words"))
        made = listed.mapInPandas(guarded(remote, local, [id_col, text_col]), f"`{id_col}` {id_type}, embedding array<double>, space string")
        wrong = F.raise_error(F.concat(F.lit("embedding length is not "), F.lit(str(dim))))
        made = made.withColumn("embedding", F.when(F.size("embedding") == dim, unit(F.col("embedding"))).otherwise(wrong))
        return made if space is not None else made.drop("space")
    listed = texts.select(id_col, word_tokens(F.col(text_col)).alias("words"))
    made = listed.mapInArrow(lambda batches: _embed_batches(batches, id_col, dim), f"`{id_col}` {id_type}, embedding array<double>")
    return made if space is None else made.withColumn("space", F.lit(LOCAL))


def embed_once(texts: DataFrame, known: DataFrame, dim: int, id_col: str, provider: Callable, space: str) -> DataFrame:
    """``(id_col, embedding, space, text_key)`` of ``texts (id_col, text)``; the provider is asked only for distinct texts that ``known (text_key, embedding, space)`` lacks in its space."""
    keyed = texts.withColumn("text_key", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    held = known.where(F.col("space") == space).dropDuplicates(["text_key"]).select("text_key", "embedding", "space")
    new = keyed.join(held.select("text_key"), "text_key", "left_anti").groupBy("text_key").agg(F.min("text").alias("text"))
    made = cut(embed(new, dim, "text_key", provider=provider, space=space))
    return keyed.join(held.unionByName(made), "text_key").select(id_col, "embedding", "space", "text_key")


@F.arrow_udf(DoubleType())
def dot(a: pa.Array, b: pa.Array) -> pa.Array:
    """Products of two columns of vectors; the two of a row are as long as each other."""
    x, y = (np.asarray(c.flatten(), np.float64) for c in (a, b))
    size = pc.fill_null(pc.list_value_length(a), 0).to_numpy()
    ends = np.concatenate([[0], np.cumsum(size)])
    sums = np.add.reduceat(np.append(x * y, 0.0), ends[:-1]) if len(size) else np.zeros(0)
    return pa.array(np.where(size > 0, sums, 0.0))
