"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(severity <= j) = sigmoid(threshold_j - w.x): one weight vector shared by all ordered thresholds. A text's
features are the hashed words that it has; its score is the expected severity, the sum of P(severity >= j).

Labels say toxic or not. Grades are made of them when the model is fitted: 0 for texts that aren't toxic;
toxic ones get 1, 2 or 3 by how many of their words are marked (at least ``MARKED_ODDS`` times as frequent
among toxic texts as elsewhere), cut at the terciles of the fitting sample. Features are words whose log odds ratio with the
label is at least ``LEAST_Z`` standard errors from 0; others only let a fit learn its sample by heart. The fit uses at most
``train_docs`` labelled documents, those with the least MD5 of their identifier.

Nulls and corner cases. A null or empty text has no features: its severity is that of the thresholds alone.
Rows with a null label, or whose identifier is null, teach nothing; of several labels of a document the
highest counts. Without a toxic label, all severities are 0. Identifiers that repeat are scored row by row.
Ties: a text half-way
between grades gets the higher one. Identifiers are whole numbers (others are an error of the cast). An empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import col

from . import bytewords as bw
from .sampling import least_by_md5

TRAIN_DOCS, GRADES, BITS = 8000, 4, 20
MARKED_ODDS, LEAST_DOCS, LEAST_Z = 6.0, 4, 2.5
ROUNDS, RATE, L2 = 500, 0.1, 1e-5


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row, feature, times) of each piece of a text column."""
    for lo, hi, buf, offs in bw.pieces(column):
        starts, ends, first = bw.words(buf, offs, bw.ALNUM)
        feature = (bw.hash_spans(buf, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        key, times = np.unique((row << BITS) | feature, return_counts=True)
        yield lo, hi, key >> BITS, key & ((1 << BITS) - 1), times


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, row, feature, times in _features(batch.column(1)):
            offsets = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (feature, times)]
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), *lists], ["label", "features", "times"])


@dataclass
class OrdinalModel:
    weights: np.ndarray  # by feature
    thresholds: np.ndarray  # ascending, one fewer than grades


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def likelihood(params: np.ndarray, row: np.ndarray, feature: np.ndarray, grade: np.ndarray, n_features: int, grades: int = GRADES) -> tuple[float, np.ndarray]:
    """(mean negative log likelihood with the ridge, its gradient). Parameters: weights, the first threshold, logs of the gaps."""
    n = len(grade)
    ends = np.searchsorted(row, np.arange(n + 1))
    filled = np.flatnonzero(np.diff(ends))
    w, gaps = params[:n_features], np.exp(params[n_features + 1 :])
    theta = params[n_features] + np.concatenate([[0], np.cumsum(gaps)])
    score = np.zeros(n)
    score[filled] = np.add.reduceat(w[feature], ends[filled]) if len(filled) else 0
    upper = np.concatenate([theta, [np.inf]])[grade] - score
    lower = np.concatenate([[-np.inf], theta])[grade] - score
    fu, fl = _sigmoid(upper), _sigmoid(lower)
    p = np.maximum(fu - fl, 1e-12)
    du, dl = fu * (1 - fu) / p, fl * (1 - fl) / p
    g_theta = np.array([dl[grade == j + 1].sum() - du[grade == j].sum() for j in range(grades - 1)]) / n
    g_score = (du - dl) / n
    grad = np.empty_like(params)
    grad[:n_features] = np.bincount(feature, weights=g_score[row], minlength=n_features) + L2 * w
    grad[n_features] = g_theta.sum()
    grad[n_features + 1 :] = gaps * np.cumsum(g_theta[::-1])[::-1][1:]
    return float(-np.log(p).mean() + 0.5 * L2 * (w @ w)), grad


def fit_ordinal(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, n_features: int, grades: int = GRADES, rounds: int = ROUNDS) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam on all rows. (row, feature) are the ones of a sparse matrix."""
    n = len(grade)
    share = np.array([max(1, int((grade <= j).sum())) / n for j in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    theta = np.log(share / (1 - share))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(grades - 1))
    params = np.concatenate([np.zeros(n_features), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        _, grad = likelihood(params, row, feature, grade, n_features, grades)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        params = params - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(params[:n_features], params[n_features] + np.concatenate([[0], np.cumsum(np.exp(params[n_features + 1 :]))]))


def _grades(row, feature, times, toxic: np.ndarray) -> np.ndarray:
    """Grades of the fitting sample: terciles of the marked words of its toxic texts."""
    hot, cold = (np.bincount(feature, weights=toxic[row] == k, minlength=1 << BITS) for k in (1, 0))
    n_hot, n_cold = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    marked = (hot >= LEAST_DOCS) & ((hot / n_hot) >= MARKED_ODDS * (cold + 0.5) / n_cold)
    count = np.bincount(row, weights=times * marked[feature], minlength=len(toxic))
    low, high = np.quantile(count[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (count > low) + (count > high), 0)


def _telling(row: np.ndarray, feature: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features of at least LEAST_DOCS texts whose log odds ratio with the label is LEAST_Z standard errors from 0."""
    hot, cold = (np.bincount(feature, weights=toxic[row] == k, minlength=1 << BITS) for k in (1, 0))
    a, b = hot + 0.5, cold + 0.5
    c, d = toxic.sum() - hot + 0.5, (toxic == 0).sum() - cold + 0.5
    z = np.log(a * d / (b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return np.flatnonzero((hot + cold >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> OrdinalModel | None:
    """Fit on a bounded sample of labelled documents; None if no label says toxic."""
    known = labels.filter(col(label_col).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    chosen = F.broadcast(least_by_md5(known, train_docs))
    texts = docs.filter(col(text_col).isNotNull()).select(col(id_col).alias("id"), F.lower(col(text_col)).alias("text")).join(chosen, "id")
    table = texts.select("id", "text", F.col("label").cast("int")).mapInArrow(bw.tidied(_listed), "label int, features array<int>, times array<int>").toArrow().combine_chunks()
    toxic = (table["label"].to_numpy() > 0).astype(np.int64)
    if not toxic.any():
        return None
    lists = table["features"].combine_chunks()
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    row, feature, times = np.repeat(np.arange(len(toxic)), size), lists.flatten().to_numpy().astype(np.int64), table["times"].combine_chunks().flatten().to_numpy()
    grade = _grades(row, feature, times, toxic)
    frequent = _telling(row, feature, toxic)
    at = np.full(1 << BITS, -1)
    at[frequent] = np.arange(len(frequent))
    used = at[feature] >= 0
    small = fit_ordinal(row[used], at[feature[used]], grade, len(frequent))
    weights = np.zeros(1 << BITS, np.float32)
    weights[frequent] = small.weights
    return OrdinalModel(weights, small.thresholds)


def _score(model: OrdinalModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            score = np.zeros(n)
            if model is None:
                above = np.zeros((n, GRADES - 1))
            else:
                for lo, hi, row, feature, _ in _features(batch.column(1)):
                    score[lo:hi] = np.bincount(row, weights=model.weights[feature], minlength=hi - lo)
                above = _sigmoid(score[:, None] - model.thresholds[None, :])
            grade = (above >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(above.sum(axis=1), 6)), pa.array(np.round(above[:, 0], 6)), pa.array(grade.astype(np.int32)), pa.array(grade >= 1)], ["id", "severity", "p", "grade", "toxic"])

    return run


def severity(docs: DataFrame, labels: DataFrame, model: OrdinalModel | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, expected_severity, p_toxic, grade, is_toxic) for every row; ``grade`` is the median grade."""
    bw.bound_batches(docs.sparkSession)
    model = model or train(docs, labels, id_col, text_col, label_col)
    rows = docs.select(col(id_col).cast("bigint").alias("id"), F.lower(col(text_col)).alias("text"))
    return rows.mapInArrow(bw.tidied(_score(model)), "id bigint, severity double, p double, grade int, toxic boolean").toDF("doc_id", "expected_severity", "p_toxic", "grade", "is_toxic")
