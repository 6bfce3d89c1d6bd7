"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every document becomes a short vector of transformed statistics (lengths, character classes, repetition,
line shape). Class means and covariances come from per-partition moment sums, covariances are shrunk towards
the pooled one and a scaled identity, and a score is the posterior from the two Mahalanobis log-densities,
computed with Cholesky factors cached in the broadcast model.

Defined cases: null and empty texts have the statistics of a text without words and get a score like any
other; repeated rows get equal scores; an empty table gives an empty result; columns of the input other than
``text`` are never read. Without both labels in the training rows every score is the share of the label seen
(0.5 with none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, words

FEATURES = (
    "log_words", "log_word_length", "upper", "symbol", "bang", "bar", "digit", "distinct", "repeat_next",
    "bigram_distinct", "log_words_per_line", "line_repeat", "word_tail_symbol", "word_head_upper", "top_share", "non_ascii",
)
DIM = len(FEATURES)

_CLASSES = np.zeros(256, dtype=np.uint8)  # bit per class
for _c in range(128):
    _s = chr(_c)
    _CLASSES[_c] = 1 * _s.isupper() + 2 * _s.islower() + 4 * _s.isdigit() + 8 * (_s in "#$%&*+/<=>@\\^_`{|}~[]") + 16 * (_s == "!") + 32 * (_s == "|")
_CLASSES[128:] = 64


def _span_sum(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, dtype=np.float64)
    np.cumsum(x, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct_and_top(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner: number of distinct keys, and the count of the commonest."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(keys):
        order = np.lexsort((keys, owner))
        k, o = keys[order], owner[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(k)))
        np.add.at(distinct, o[at], 1)
        np.maximum.at(top, o[at], counts)
    return distinct, top


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    out = np.zeros((len(texts), DIM))
    root = lambda a, b: np.sqrt(a / np.maximum(b, 1))  # noqa: E731  a variance-stabilising transform of shares
    for w in words(texts, lower=False, split_punctuation=False):
        n = len(w.offsets) - 1
        cls = _CLASSES[w.data]
        count = lambda bit: _span_sum((cls & bit) > 0, w.offsets)  # noqa: E731, B023
        size = np.diff(w.offsets).astype(float)
        n_words = np.diff(w.bounds).astype(float)
        owner = np.repeat(np.arange(n), np.diff(w.bounds))
        upper, lower = count(1), count(2)
        distinct, top = _distinct_and_top(w.hashes, owner, n)
        same = np.zeros(len(w.hashes))
        pair = w.hashes.copy()
        if len(pair) > 1:
            inside = owner[1:] == owner[:-1]
            same[1:] = inside & (w.hashes[1:] == w.hashes[:-1])
            pair[1:] += np.uint64(0x9E3779B97F4A7C15) * np.where(inside, w.hashes[:-1], np.uint64(1))
        bigrams, _ = _distinct_and_top(pair, owner, n)
        breaks = w.data == 10
        lines = _span_sum(breaks, w.offsets) + 1
        head, tail = _CLASSES[w.data[w.starts]], w.data[w.ends - 1]
        tail_symbol = (_CLASSES[tail] & (8 | 16)) > 0
        # a line's key: the sum of its word hashes
        line_of = np.cumsum(breaks)[w.starts] if len(w.starts) else np.zeros(0, dtype=int)
        line_start = np.ones(len(line_of), dtype=bool)
        if len(line_of) > 1:
            line_start[1:] = (line_of[1:] != line_of[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(line_start)
        keys = np.add.reduceat(w.hashes, at) if len(at) else np.zeros(0, dtype=np.uint64)
        line_distinct, _ = _distinct_and_top(keys, owner[at], n)
        filled = np.bincount(owner[at], minlength=n).astype(float)
        rows = slice(w.first, w.first + n)
        out[rows] = np.column_stack([
            np.log1p(n_words), np.log1p(size / np.maximum(n_words, 1)), root(upper, upper + lower), root(count(8), size), root(count(16), size), root(count(32), size),
            root(count(4), size), root(distinct, n_words), root(_span_sum(same, w.bounds), n_words), root(bigrams, n_words), np.log1p(n_words / lines),
            root(filled - line_distinct, filled), root(_span_sum(tail_symbol, w.bounds), n_words), root(_span_sum((head & 1) > 0, w.bounds), n_words), root(top, n_words), root(count(64), size),
        ])
    return out


@dataclass(frozen=True)
class Qda:
    """Log priors, means and inverse Cholesky factors of both classes, and log-determinants; or a constant score."""

    log_prior: tuple[float, float] | None
    mean: np.ndarray | None = None
    whiten: np.ndarray | None = None
    log_det: np.ndarray | None = None
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.log_prior is None:
            return np.full(len(x), self.constant)
        logs = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.whiten[c].T  # Mahalanobis distance through the cached factor
            logs.append(self.log_prior[c] - 0.5 * ((z * z).sum(axis=1) + self.log_det[c]))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and class: row count, sum and sum of outer products."""
    total = {c: [0.0, np.zeros(DIM), np.zeros((DIM, DIM))] for c in (0, 1)}
    for b in batches:
        x, y = statistics(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
        for c in (0, 1):
            own = x[y == c]
            total[c][0] += len(own)
            total[c][1] += own.sum(axis=0)
            total[c][2] += own.T @ own
    rows = [(c, i, float(v)) for c, (n, s, q) in total.items() if n for i, v in enumerate(np.concatenate([[n], s, q.ravel()]))]
    if rows:
        y, i, v = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(i, pa.int32()), pa.array(v, pa.float64())], names=["y", "i", "v"])


def fit_quality(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 40_000, shrink_pooled: float = 0.1, shrink_identity: float = 0.02) -> Qda:
    """Fit on at most ``max_fit_rows`` labelled rows that are not held out.

    What reaches the driver is two moment vectors of 1 + d + d*d numbers. ``shrink_pooled`` moves each class
    covariance towards the pooled one, ``shrink_identity`` towards the mean variance on the diagonal.
    """
    sample = labelled_sample(docs, labels, "quality", max_fit_rows)
    got = sample.mapInArrow(_moments, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    sums = {c: np.zeros(1 + DIM + DIM * DIM) for c in (0, 1)}
    for r in got:
        sums[r.y][r.i] = r.v
    n = [sums[c][0] for c in (0, 1)]
    if min(n) < 2:
        return Qda(None, constant=n[1] / sum(n) if sum(n) else 0.5)
    mean = np.array([sums[c][1 : 1 + DIM] / n[c] for c in (0, 1)])
    cov = [sums[c][1 + DIM :].reshape(DIM, DIM) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    whiten, log_det = [], []
    for c in (0, 1):
        s = (1 - shrink_pooled) * cov[c] + shrink_pooled * pooled
        s = (1 - shrink_identity) * s + shrink_identity * max(np.trace(s) / DIM, 1e-9) * np.eye(DIM)
        factor = np.linalg.cholesky(s + 1e-9 * np.eye(DIM))
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Qda((float(np.log(n[0] / sum(n))), float(np.log(n[1] / sum(n)))), mean, np.array(whiten), np.array(log_det))


def quality_score(model: Qda, text: Column) -> Column:
    """Score column, 0 to 1: the posterior of label 1. The row's other columns stay in the JVM."""

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(texts)), pa.float64())

    return F.arrow_udf(score, T.DoubleType())(text)


def score_quality(docs: DataFrame, model: Qda, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every document; predicted is 1 from ``threshold`` on."""
    scored = docs.select("doc_id", quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
