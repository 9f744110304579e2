"""Quality classifier: regularised quadratic discriminant over document statistics.

One pass over the texts turns each into a row of transformed statistics, written to the
checkpoint folder; class moments are a Spark aggregation over all labelled rows. Each class covariance is
shrunk towards the pooled one and that towards a scaled identity; its Cholesky factor is computed once and
travels with the broadcast model, and scores are differences of Mahalanobis log densities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.batches import column, column_bytes, parts, small_batches
from groundspark.runtime import cut

FEATURES = [
    "log_bytes", "log_words", "log_word_length", "log_line_words", "letters", "capitals", "digits", "spaces",
    "marks", "symbols", "wide", "distinct_words", "top_word", "short_words", "long_words", "repeated_lines",
    "line_stops", "words_in_lines",
]
_CLASS = np.zeros(256, dtype=np.intp)
for _k, _chars in enumerate([range(97, 123), range(65, 91), range(48, 58), [9, 10, 11, 12, 13, 32], b".,;:!?'\"()-", range(128, 256)], start=1):
    _CLASS[list(_chars)] = _k


def _logit(part: float, whole: float) -> float:
    """Smoothed log odds of a share."""
    return float(np.log((part + 0.5) / (max(whole - part, 0.0) + 0.5)))


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of a whole text (see ``FEATURES``); a null text counts as empty."""
    text = text or b""
    kinds = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=7)
    n, words, lines = len(text), text.lower().split(), [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    m = len(words)
    return [
        np.log1p(n), np.log1p(m), np.log1p(lengths.mean() if m else 0.0), np.log1p(m / max(len(lines), 1)),
        _logit(kinds[1], n), _logit(kinds[2], n), _logit(kinds[3], n), _logit(kinds[4], n),
        _logit(kinds[5], n), _logit(kinds[0], n), _logit(kinds[6], n), _logit(len(counts), m),
        _logit(max(counts.values(), default=0), m), _logit(float((lengths <= 3).sum()), m), _logit(float((lengths >= 12).sum()), m),
        _logit(len(lines) - len(set(lines)), len(lines)), _logit(sum(x.rstrip()[-1:] in b".!?" for x in lines), len(lines)),
        _logit(len(_SENTENCE.findall(text)), max(m, 1)),
    ]


_SENTENCE = re.compile(rb"[.!?](?:\s|$)")


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x)`` for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            rows = np.array([statistics(t) for t in column_bytes(batch, "text")], dtype=float).reshape(-1, len(FEATURES))
            x = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), x], ["id", "x"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, x array<double>")


@dataclass(frozen=True)
class QualityModel:
    log_prior: np.ndarray  # [2]
    mean: np.ndarray  # [2, D]
    inverse_root: np.ndarray  # [2, D, D], inverse Cholesky factors
    log_det: np.ndarray  # [2]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for rows of ``x``."""
        logits = np.empty((2, len(x)))
        for k in range(2):
            z = (x - self.mean[k]) @ self.inverse_root[k].T
            logits[k] = self.log_prior[k] - 0.5 * self.log_det[k] - 0.5 * (z * z).sum(axis=1)
        return 1.0 / (1.0 + np.exp(np.clip(logits[0] - logits[1], -700, 700)))


def fit(rows: DataFrame, shrink: float = 0.2, ridge: float = 0.05) -> QualityModel:
    """Fit on all of ``rows (x array<double>, label int)``.

    Moments are summed in the tasks and added up by Spark; what reaches the driver is two
    matrices, however many rows there are. With no row of a class, that class takes the other's moments and
    a prior of half a row; with no rows at all every score is 0.5.
    """
    d = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = column(batch, "label").to_numpy(zero_copy_only=False)
            x = np.asarray(column(batch, "x").flatten()).reshape(-1, d)
            for k in range(2):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        k, at = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(at.ravel()), pa.array(sums.ravel())], ["k", "at", "v"])

    cells = rows.select("x", F.col("label").cast("int").alias("label")).mapInArrow(moments, "k long, at long, v double")
    sums = np.zeros((2, 1 + d + d * d))
    for r in cells.groupBy("k", "at").agg(F.sum("v").alias("v")).toPandas().itertuples():
        sums[r.k, r.at] = r.v
    n = sums[:, 0].copy()
    if n.sum() == 0:
        return QualityModel(np.log([0.5, 0.5]), np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    sums[n == 0] = sums[n > 0][0] if (n == 0).any() else 0
    size = sums[:, 0]
    mean = sums[:, 1 : 1 + d] / size[:, None]
    cov = sums[:, 1 + d :].reshape(2, d, d) / size[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * size[:, None, None]).sum(axis=0) / size.sum()
    target = np.eye(d) * max(np.trace(pooled) / d, 1e-6)
    roots, dets = [], []
    for k in range(2):
        # Classes with few rows lean on the pooled covariance more.
        lam = min(1.0, shrink + d / (d + size[k]))
        root = np.linalg.cholesky((1 - ridge) * ((1 - lam) * cov[k] + lam * pooled) + ridge * target)
        roots.append(np.linalg.inv(root))
        dets.append(2 * np.log(np.diag(root)).sum())
    prior = np.maximum(n, 0.5)
    return QualityModel(np.log(prior / prior.sum()), mean, np.stack(roots), np.array(dets))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    train_on=None,
) -> DataFrame:
    """``(id_col, score, predicted)`` for every row of ``docs``.

    ``labels`` holds 0 or 1 in ``label_col`` by ``id_col``; other values, nulls and ids without a document
    teach nothing, repeated label rows count once each distinct, repeated documents each time. ``train_on`` maps the column of ids
    to a condition on what may be learned from. Null texts score like empty ones; repeated rows
    are all scored; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    marked = cut(featurise(docs, id_col, text_col))
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).distinct()
    if train_on is not None:
        known = known.where(train_on(F.col("id")))
    model = fit(marked.join(known, "id").select("x", "label"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(column(batch, "x").flatten()).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(shared.value.scores(x))], ["id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    scored = marked.mapInArrow(run, f"id {id_type}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
