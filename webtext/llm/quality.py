"""Regularised quadratic discriminant on document statistics (operator 5).

Every text gives a few transformed statistics (shares on the arcsine scale,
counts on the log scale).  Per class, the mean and covariance come from sums
over all learning rows; each covariance is shrunk towards the pooled one and
towards its own mean variance, so that statistics which hardly vary in a class
do not make it singular.  A score is the posterior of class 1: the difference of
Mahalanobis log-densities, computed with Cholesky factors that are worked out
once and sent along.

Defined results: a null text is empty; an empty text has all-zero statistics and
is scored like any other; labels that are null or name no document are not
learned from, a document labelled twice is learned from twice.  With learning
rows of one class only every score is that class's share; with none it is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, plain

#: Shares of the pooled covariance and of a round covariance in each class.
TO_POOLED, TO_ROUND, FLOOR = 0.10, 0.05, 1e-4

STATISTICS = ["log_words", "word_length", "upper", "digits", "symbols", "marks", "stops", "distinct",
              "adjacent", "repeated_lines", "words_per_line", "bars"]

_UPPER, _DIGIT, _SYMBOL, _MARK, _ALPHA = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_ALPHA[65:91] = _ALPHA[97:123] = True
_ALPHA[128:] = True
_SYMBOL[list(b"#*$%&<>{}[]\\^_=~+@")] = True
_MARK[list(b"!?")] = True


def _share(part: float, whole: float) -> float:
    """Arcsine of the square root of a share: spreads values near 0 and 1."""
    return float(np.arcsin(np.sqrt(min(1.0, part / whole)))) if whole else 0.0


def statistics(text: str) -> list[float]:
    """The numbers of ``STATISTICS`` for one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    visible = len(raw) - int(by[[9, 10, 11, 12, 13, 32]].sum())
    letters = int(by[_ALPHA].sum())
    lines = [line for line in map(str.strip, text.split("\n")) if line]
    adjacent = sum(map(str.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)),
        float(np.log1p(sum(map(len, words)) / n)),
        _share(int(by[_UPPER].sum()), letters),
        _share(int(by[_DIGIT].sum()), visible),
        _share(int(by[_SYMBOL].sum()), visible),
        _share(int(by[_MARK].sum()), visible),
        _share(int(by[[44, 46, 59, 58]].sum()), n),
        _share(len(set(words)), n),
        _share(adjacent, n),
        _share(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / len(lines))),
        _share(int(by[124]), n),
    ]


def held_out(doc_id: int | None, folds: int = 3, fold: int = 1) -> bool:
    """crc32 of the id as text, modulo ``folds``; a null id is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor and half log-determinant."""

    prior: np.ndarray
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    half_logdet: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior[1])
        logs = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.factors[c].T
            logs.append(np.log(self.prior[c]) - self.half_logdet[c] - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def discriminant(counts: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
    """The model from each class's row count, sums and sums of products."""
    if counts.min() < 2:
        return Discriminant(counts / counts.sum() if counts.sum() else np.array([0.5, 0.5]))
    means = sums / counts[:, None]
    own = [products[c] / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = sum(own[c] * counts[c] for c in (0, 1)) / counts.sum()
    factors, half = [], []
    for c in (0, 1):
        s = (1 - TO_POOLED - TO_ROUND) * own[c] + TO_POOLED * pooled
        s += (TO_ROUND * np.trace(own[c]) / len(s) + FLOOR) * np.eye(len(s))
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        half.append(float(np.log(np.diag(low)).sum()))
    return Discriminant(counts / counts.sum(), means, np.array(factors), np.array(half))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Callable[[int | None], bool]) -> Discriminant:
    """Learn from the labelled documents that ``learn_from`` accepts: all of them,
    as sums of moments that each task adds up; two rows per task reach the driver."""
    on_workers(docs.sparkSession)
    marked = (labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"),
                                                                F.col("quality").cast("int").alias("quality")))
    k = len(STATISTICS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = [i for i, d in enumerate(ids) if learn_from(d)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array([ids[i] for i in at], pa.int64()),
                 "x": pa.array([statistics(texts[i]) for i in at], pa.list_(pa.float64()))})

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + k + k * k))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(0).to_pylist())
            y = b.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_pydict({"c": pa.array([0, 1], pa.int32()),
                                          "m": pa.array(list(total), pa.list_(pa.float64()))})

    # statistics meet the labels, not texts: a few numbers a row are dealt out
    measured = plain(docs).mapInArrow(measure, "doc_id long, x array<double>")
    rows = measured.join(marked, "doc_id").select("x", "quality").mapInArrow(moments, "c int, m array<double>") \
        .select("c", F.posexplode("m").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + k + k * k))
    for r in rows:
        total[r.c, r.i] = r.v
    return discriminant(total[:, 0], total[:, 1:1 + k], total[:, 1 + k:].reshape(2, k, k))


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id, score, predicted`` of every row, from its text alone."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            if b.num_rows:
                s = model.scores(np.array([statistics(t) for t in b.column(1).to_pylist()]))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(s),
                                                  "predicted": pa.array((s >= 0.5).astype(np.int32))})

    return plain(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Discriminant) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text the model accepts."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        """Texts alone go to Python, 1,024 of them as objects at once; rows stay where they are."""
        model, out = shared.value, []
        for start in range(0, len(texts), 1024):
            x = np.array([statistics(t or "") for t in texts.slice(start, 1024).to_pylist()])
            out.append(model.scores(x) >= 0.5)
        return pa.array(np.concatenate(out) if out else [], pa.bool_())

    return docs.filter(accepted("text"))
