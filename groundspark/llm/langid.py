"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting for training runs as a Spark aggregation over a bounded, hash-ordered sample of the
labelled rows; the log-probability matrix (buckets x languages) is broadcast, in slices of languages if it is
large, and batches of texts are scored sparsely in numpy: only the buckets that occur are looked up, and summed by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.batches import column, parts, slices, small_batches
from groundspark.runtime import cut

#: Labelled rows that the model is fitted on at most, and what is broadcast of the matrix at once.
MAX_TRAIN_ROWS = 6000
MAX_MATRIX_BYTES = 32 << 20
ORDERS = (1, 2, 3)
BUCKET_BITS = 16
#: Characters handled at once in a task.
BLOCK = 1 << 17
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    log_prior: np.ndarray  # float64[L]
    log_prob: np.ndarray  # float32[buckets, L]
    bits: int


def _codes(text: str) -> np.ndarray:
    folded = " " + " ".join(text.lower().split()) + " "
    return np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _buckets(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position of ``codes`` (len - order + 1 of them)."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.full(n, 0x9E37 + order, dtype=np.uint32)
    for k in range(order):
        h ^= codes[k : k + n]
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def gram_blocks(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in blocks of bounded size; every n-gram is in one block."""
    for at in range(0, len(codes), BLOCK):
        for order in ORDERS:
            yield _buckets(codes[at : at + BLOCK + order - 1], order, bits)


def train(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    max_rows: int = MAX_TRAIN_ROWS,
    alpha: float = 0.1,
) -> LanguageModel:
    """Fit on at most ``max_rows`` rows of ``labelled`` (the first by a hash of the id, then by language and text), whole texts.

    Rows without a language are left out before that, those of the sample without a text after it; repeated rows count as often as they
    occur in the sample. Ids alone decide, so texts outside the sample aren't read. The driver holds 256 KB a language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit(17), id_col).alias("order"))
    last = rows.select("order").orderBy("order").limit(max_rows).agg(F.max("order").alias("m")).first()["m"]
    bits = BUCKET_BITS
    none = LanguageModel([], np.zeros(0), np.zeros((1 << bits, 0), np.float32), bits)
    if last is None:
        return none
    below = cut(rows.where(F.col("order") < last).select("text", "lang"))
    # Repeated ids share a hash; of those at the end of the sample only as many as fit are taken.
    tied = rows.where(F.col("order") == last).select("text", "lang").orderBy("lang", "text").limit(max_rows - below.count())
    sample = below.unionByName(tied).where("text is not null")
    docs = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not docs:
        return none
    langs = sorted(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in parts(batches, "text"):
            for text, lang in zip(column(batch, "text").to_pylist(), column(batch, "lang").to_pylist(), strict=True):
                mine = totals.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                for buckets in gram_blocks(_codes(text), bits):
                    mine += np.bincount(buckets, minlength=1 << bits)
        for lang, mine in totals.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(mine[at])], ["lang", "at", "n"])

    cells = sample.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    log_prob = np.empty((1 << bits, len(langs)), dtype=np.float32)
    for k, lang in enumerate(langs):
        mine, own = np.full(1 << bits, alpha), cells[cells["lang"] == lang]
        mine[own["at"].to_numpy(dtype=np.int64)] += own["n"].to_numpy()
        log_prob[:, k] = np.log(mine / mine.sum())
    prior = np.array([docs[x] for x in langs], dtype=float)
    return LanguageModel(langs, np.log(prior / prior.sum()), log_prob, bits)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def totals(codes: list[np.ndarray], log_prob: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Summed log probabilities (texts x languages) and numbers of n-grams of texts, the short ones together.

    The texts' n-grams are the rows of a sparse matrix of counts: the buckets that occur are looked up at once and summed by text.
    """
    sums, grams = np.zeros((len(codes), log_prob.shape[1])), np.zeros(len(codes), dtype=np.int64)
    for start, stop in slices([len(c) for c in codes], BLOCK):
        if stop - start == 1:
            for buckets in gram_blocks(codes[start], bits):
                sums[start] += log_prob[buckets].sum(axis=0, dtype=np.float64)
                grams[start] += len(buckets)
            continue
        row, ends = np.concatenate(codes[start:stop]), np.cumsum([len(c) for c in codes[start:stop]])
        to_end = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(row))
        for order in ORDERS:
            inside = to_end[: max(len(row) - order + 1, 0)] >= order  # not across the end of a text
            n = np.maximum(np.diff(ends, prepend=0) - order + 1, 0)
            some = np.flatnonzero(n)
            if len(some):
                found = log_prob[_buckets(row, order, bits)[inside]]
                sums[start + some] += np.add.reduceat(found, (np.cumsum(n) - n)[some], axis=0, dtype=np.float64)
            grams[start:stop] += n
    return sums, grams


@dataclass(frozen=True)
class Slice:
    """Some of a model's languages, few enough to be broadcast."""

    langs: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    bits: int


def model_slices(model: LanguageModel, max_bytes: int = MAX_MATRIX_BYTES) -> list[Slice]:
    each = max(1, max_bytes // (4 << model.bits))
    return [Slice(model.langs[k : k + each], model.log_prior[k : k + each], np.ascontiguousarray(model.log_prob[:, k : k + each]), model.bits) for k in range(0, len(model.langs), each)]


#: What is known of a text after some slices: best language and its log density, and of the scaled densities the highest, that of the best, and their sum.
STATE = pa.schema([("_lang", pa.string()), ("_best", pa.float64()), ("_own", pa.float64()), ("_top", pa.float64()), ("_sum", pa.float64())])
_NOTHING = (None, -np.inf, -np.inf, -np.inf, 0.0)


def score_slice(texts: list[str | None], states: list[tuple], part: Slice, sharpness: float) -> list[tuple]:
    """The states of texts after one more slice of languages; a text without a letter keeps its state."""
    asked = [i for i, t in enumerate(texts) if t is not None and _has_letter(t)]
    out = list(states)
    sums, grams = totals([_codes(texts[i]) for i in asked], part.log_prob, part.bits)
    full = sums + part.log_prior
    scaled = part.log_prior + sums * np.minimum(1.0, sharpness / np.maximum(grams, 1))[:, None]
    for row, i in enumerate(asked):
        lang, best, own, top, total = out[i]
        k = int(np.argmax(full[row]))
        if lang is None or full[row, k] > best:
            lang, best, own = part.langs[k], float(full[row, k]), float(scaled[row, k])
        higher = max(top, float(scaled[row].max()))
        total = total * np.exp(top - higher) + float(np.exp(scaled[row] - higher).sum())
        out[i] = (lang, best, own, higher, total)
    return out


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None, sharpness: float = 40.0, max_bytes: int = MAX_MATRIX_BYTES) -> DataFrame:
    """Columns ``keep`` of ``docs`` (by default all) with ``lang_pred`` and ``score``.

    The score is the posterior of the best language with the likelihood of a text of more than
    ``sharpness`` n-grams scaled down to that many, so that long texts don't all score 1. Null texts
    and texts without a letter get ``und`` and 0, and so does every text if nothing was learned.
    Existing columns of the two names give way. Every row of ``docs`` gives one row; ties between
    languages go to the first in the order of their names. A matrix of more than ``max_bytes`` is broadcast in
    slices of languages; between them the texts are written to the checkpoint folder.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    states = "_lang string, _best double, _own double, _top double, _sum double"
    start = [F.lit(v).cast("string" if k == 0 else "double").alias(name) for k, (name, v) in enumerate(zip(STATE.names, _NOTHING, strict=True))]
    out = docs.select(*keep, F.col(text_col).alias("_text"), *start)
    slices_of = model_slices(model, max_bytes)
    for k, part in enumerate(slices_of):
        more = k + 1 < len(slices_of)
        out = out.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(part), keep, sharpness, more), f"{fields}{'_text string, ' if more else ''}{states}")
        if more:
            out = cut(out)
    known = F.col("_lang").isNotNull()
    score = F.when(known, F.exp(F.col("_own") - F.col("_top")) / F.col("_sum")).otherwise(0.0)
    return out.select(*keep, F.coalesce("_lang", F.lit(UNDETERMINED)).alias("lang_pred"), score.alias("score"))


def _scorer(shared, keep: list[str], sharpness: float, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "_text"):
            states = list(zip(*(column(batch, c).to_pylist() for c in STATE.names), strict=True))
            states = score_slice(column(batch, "_text").to_pylist(), states, shared.value, sharpness)
            made = [pa.array(x, t) for x, t in zip(zip(*states, strict=True), STATE.types, strict=True)] if states else [pa.array([], t) for t in STATE.types]
            names = [*keep, "_text"] if with_text else keep
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *made], [*names, *STATE.names])

    return run
