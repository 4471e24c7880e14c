"""Document quality by positive-unlabelled learning with a non-negative risk.

Trusted positives are documents labelled good; all documents without a label are unlabelled text. The
classifier g minimises  prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])  with the sigmoid loss. The class prior is
estimated on held-out halves, each in turn, and averaged: of the ratios of the share of unlabelled to the share of positive documents
above a score, the one with the least upper confidence bound.

Features are shares and ratios of a text (letters, capitals, digits, marks, white space, word and line
lengths, distinct words and lines, the most frequent word), each in one of 16 quantile bins. They are computed once,
written and read again. Of positives the fit uses at most ``n_positive``, those with the least MD5 of their
identifier; bin edges, prior and risk rest on all unlabelled documents. Edges come from counts of values to 12
significant bits. The bins of unlabelled documents, 13 bytes each, are a written table: every evaluation of the risk is a
pass over it that sends back a sum a task, of at most ``TASKS`` tasks, and a quasi-Newton method needs few of them.

Nulls and corner cases. A null or empty text gets the features of an empty text. Null labels count as no
label; of several labels of a document the lowest counts. Identifiers are whole numbers (others are an error of the cast). Rows whose identifier is null teach nothing and are scored. Without positives, or without unlabelled
documents, the prior is 1 and every score is 1. Ties: a score of exactly one half does not keep. Identifiers that repeat are scored row by row. An empty
table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import col, drop_path, materialise

from . import bytewords as bw
from .sampling import least_by_md5

N_POSITIVE, BINS = 6000, 16
ROUNDS, PRIOR_ROUNDS, L2 = 40, 15, 1e-4
N_FEATURES = 13
#: Tasks of a pass over the bins, at most, and rows for each at least.
TASKS, TASK_ROWS = 256, 500_000

_KIND = np.full(256, 3, np.int8)  # letter 0, capital 1, digit 2, mark 3, white space 4
_KIND[97:123], _KIND[128:256], _KIND[65:91], _KIND[48:58] = 0, 0, 1, 2
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights=weights, minlength=n).astype(np.float64)


def _spans(buf, offs, table, n):
    """(row of each span, its bytes, its hash) of words or lines."""
    starts, ends, first = bw.words(buf, offs, table)
    return np.repeat(np.arange(n), np.diff(first)), (ends - starts).astype(np.float64), bw.hash_spans(buf, starts, ends)


def text_features(column: pa.Array) -> np.ndarray:
    """Rows x features of a text column."""
    out = np.zeros((len(column), N_FEATURES))
    for lo, hi, buf, offs in bw.pieces(column):
        n = hi - lo
        size = np.diff(offs).astype(np.float64)
        row = np.repeat(np.arange(n), np.diff(offs))
        kinds = np.bincount(row * 5 + _KIND[buf[: int(offs[-1])]], minlength=5 * n).reshape(n, 5) / np.maximum(size, 1)[:, None]
        word_row, word_size, word_hash = _spans(buf, offs, bw.NOT_SPACE, n)
        line_row, line_size, line_hash = _spans(buf, offs, _NOT_NEWLINE, n)
        words, lines = _per_row(word_row, n), _per_row(line_row, n)

        def distinct(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.lexsort((h, at))
            a, b = at[order], h[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            most = np.zeros(n)
            np.maximum.at(most, a[begin], np.diff(np.concatenate([begin, [len(a)]])))
            return _per_row(a[begin], n), most

        kinds_of_words, most_frequent = distinct(word_row, word_hash)
        kinds_of_lines, _ = distinct(line_row, line_hash)
        same_as_before = _per_row(word_row[1:][(word_row[1:] == word_row[:-1]) & (word_hash[1:] == word_hash[:-1])], n)
        w, ln = np.maximum(words, 1), np.maximum(lines, 1)
        out[lo:hi] = np.column_stack([kinds, np.log1p(words), _per_row(word_row, n, word_size) / w, kinds_of_words / np.maximum(words, 1) ** 0.85, most_frequent / w, same_as_before / w, kinds_of_lines / ln, _per_row(line_row, n, line_size) / ln, kinds[:, 1] / np.maximum(kinds[:, 0], 0.01)])
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = text_features(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows x features of packed rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, N_FEATURES)


@dataclass
class QualityModel:
    edges: np.ndarray  # features x inner bin edges
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.weights[_binned(x, self.edges)].sum(axis=1) + self.bias


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.column_stack([np.searchsorted(edges[j], x[:, j], side="right") + j * (edges.shape[1] + 1) for j in range(x.shape[1])])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _logistic(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss of calling it positive, slope): log(1 + e^z)."""
    return np.logaddexp(0, z), _sigmoid(z)


def _zero_one(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss of calling it positive, slope): the sigmoid loss l(-z)."""
    up = _sigmoid(z)
    return up, up * (1 - up)


LOSSES = {"logistic": _logistic, "sigmoid": _zero_one}


def summed(bins: np.ndarray, params: np.ndarray, loss: str) -> np.ndarray:
    """Gradient of the summed loss of rows of bins by weights and bias, the summed loss, the number of rows."""
    value, slope = LOSSES[loss](params[:-1][bins].sum(axis=1) + params[-1])
    grad = np.bincount(bins.ravel(), weights=np.repeat(slope, bins.shape[1]), minlength=len(params) - 1)
    return np.concatenate([grad, [slope.sum(), value.sum(), len(bins)]])


class Rows:
    """Bins of unlabelled documents in this process; each has a fold, 0 or 1."""

    def __init__(self, bins: np.ndarray, fold: np.ndarray):
        self.bins, self.fold = bins, fold

    def _of(self, fold: int | None) -> np.ndarray:
        return self.bins if fold is None else self.bins[self.fold == fold]

    def total(self, params: np.ndarray, loss: str, fold: int | None = None) -> np.ndarray:
        return summed(self._of(fold), params, loss)

    def passed(self, params: np.ndarray, cuts: np.ndarray, fold: int) -> np.ndarray:
        """How many rows reach exactly so many of the cuts."""
        z = params[:-1][self._of(fold)].sum(axis=1) + params[-1]
        return np.bincount(np.searchsorted(cuts, z, side="right"), minlength=len(cuts) + 1)


class TableRows(Rows):
    """The same over a written table (fold int, bins binary)."""

    def __init__(self, table: DataFrame):
        self.table = table

    def _summed(self, fold: int | None, f) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    packed = b"".join(batch.column(0).to_pylist())
                    part = f(_places(np.frombuffer(packed, np.uint8).reshape(-1, N_FEATURES)))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tolist()], pa.list_(pa.float64()))], ["total"])

        rows = self.table if fold is None else self.table.filter(F.col("fold") == fold)
        parts = rows.select("bins").coalesce(TASKS).mapInArrow(bw.tidied(run), "total array<double>").collect()
        return np.sum([r["total"] for r in parts], axis=0) if parts else f(np.zeros((0, N_FEATURES), np.int64))

    def total(self, params: np.ndarray, loss: str, fold: int | None = None) -> np.ndarray:
        return self._summed(fold, lambda bins: summed(bins, params, loss))

    def passed(self, params: np.ndarray, cuts: np.ndarray, fold: int) -> np.ndarray:
        own = Rows(None, None)

        def count(bins: np.ndarray) -> np.ndarray:
            own.bins, own.fold = bins, np.zeros(len(bins), int)
            return own.passed(params, cuts, 0)

        return self._summed(fold, count)


def _minimised(f, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with halved steps. ``f`` gives a value and a gradient."""
    value, grad = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, coefficients = grad.copy(), []
        for s, y in reversed(steps):
            c = (s @ q) / (s @ y)
            coefficients.append(c)
            q -= c * y
        if steps:
            q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        else:
            q /= max(1.0, float(np.abs(grad).sum()))
        for (s, y), c in zip(steps, reversed(coefficients)):
            q += s * (c - (y @ q) / (s @ y))
        slope, step = grad @ q, 1.0
        if slope <= 1e-10:
            break
        for _ in range(12):
            after, new_grad = f(x - step * q)
            if after <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, new_grad - grad
        x, less, value, grad = x + s, value - after, after, new_grad
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        if less < 1e-7 * max(1.0, abs(value)):
            break
    return x


def telling_risk(p: np.ndarray, u: Rows, fold: int | None = None):
    """Positives against unlabelled by the logistic loss, both weighing the same."""

    def risk(params: np.ndarray) -> tuple[float, np.ndarray]:
        z = params[:-1][p].sum(axis=1) + params[-1]
        down = _sigmoid(-z) / len(p)
        grad = np.concatenate([-np.bincount(p.ravel(), weights=np.repeat(down, p.shape[1]), minlength=len(params) - 1), [-down.sum()]])
        total = u.total(params, "logistic", fold)
        w = np.append(params[:-1], 0)
        return float(np.logaddexp(0, -z).mean() + total[-2] / max(total[-1], 1) + 0.5 * L2 * (w @ w)), grad + total[:-2] / max(total[-1], 1) + L2 * w

    return risk


def non_negative_risk(p: np.ndarray, u: Rows, prior: float):
    """prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]), its gradient, and a small ridge on both."""

    def risk(params: np.ndarray) -> tuple[float, np.ndarray]:
        own, total = summed(p, params, "sigmoid"), u.total(params, "sigmoid")
        own, total = own[:-1] / own[-1], total[:-1] / max(total[-1], 1)
        rest = total - prior * own
        grad = -prior * own[:-1] + (rest[:-1] if rest[-1] > 0 else 0)
        w = np.append(params[:-1], 0)
        return float(prior * (1 - own[-1]) + max(0.0, rest[-1]) + 0.5 * L2 * (w @ w)), grad + L2 * w

    return risk


def class_prior(p_scores: np.ndarray, cuts: np.ndarray, passed: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from held-out scores; ``passed`` counts the latter by the cuts that they reach."""
    p_above = 1 - np.searchsorted(np.sort(p_scores), cuts) / len(p_scores)
    n = passed.sum()
    u_above = passed[::-1].cumsum()[::-1][1:] / n
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(p_scores)) + 1 / np.sqrt(n))
    best = np.argmin((u_above + slack) / np.maximum(p_above, 1e-9))
    return float(np.clip(u_above[best] / p_above[best], 0.01, 1.0))


def _fit(edges: np.ndarray, p: np.ndarray, u: Rows) -> QualityModel:
    """Fit on binned rows."""
    start = np.zeros(edges.shape[0] * BINS + 1)
    priors, params = [], start
    for fold in (0, 1) if len(p) > 3 else ():  # each half is scored by a fit on the other
        params = _minimised(telling_risk(p[fold::2], u, fold), start, PRIOR_ROUNDS)
        held = params[:-1][p[1 - fold :: 2]].sum(axis=1) + params[-1]
        cuts = np.unique(held)
        passed = u.passed(params, cuts, 1 - fold)
        if passed.sum():
            priors.append(class_prior(held, cuts, passed))
    prior = float(np.mean(priors)) if priors else 1.0
    params = _minimised(non_negative_risk(p, u, prior), params, ROUNDS)  # from where positives and unlabelled are told apart
    return QualityModel(edges, params[:-1], float(params[-1]), prior)


def train_on(p: np.ndarray, u: np.ndarray, edges: np.ndarray | None = None, fold: np.ndarray | None = None) -> QualityModel:
    """Fit in this process on feature rows of positives and of unlabelled documents."""
    if edges is None:
        edges = np.stack([np.quantile(np.concatenate([p[:, j], u[:, j]]), np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(p.shape[1])])
    return _fit(edges, _binned(p, edges), Rows(_binned(u, edges), np.arange(len(u)) % 2 if fold is None else fold))


def _cells(x: np.ndarray) -> np.ndarray:
    """The leading bits of values from 0 on: 8 of the exponent and 11 of the fraction, in the order of the values."""
    return x.astype(np.float32).view(np.int32) >> 12


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = _cells(_matrix(batch.column(0)))
        for j in range(N_FEATURES):
            values, counts = np.unique(cells[:, j], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), j, np.int32)), pa.array(values), pa.array(counts)], ["feature", "cell", "n"])


def bin_edges(rows: DataFrame) -> np.ndarray | None:
    """Features x inner edges from all rows' values (packed, in a column x): quantiles to a cell's width; None without rows."""
    counts = rows.select("x").mapInArrow(bw.tidied(_counted), "feature int, cell int, n bigint").groupBy("feature", "cell").agg(F.sum("n").alias("n")).toArrow()
    feature, cell, n = (counts[c].to_numpy() for c in ("feature", "cell", "n"))
    if not len(n):
        return None
    edges = []
    for j in range(N_FEATURES):
        order = np.argsort(cell[feature == j])
        values, upto = cell[feature == j][order], n[feature == j][order].cumsum()
        at = np.searchsorted(upto, np.linspace(0, 1, BINS + 1)[1:-1] * (upto[-1] - 1), side="right")
        edges.append((values[at].astype(np.int32) << 12).view(np.float32).astype(np.float64))
    return np.stack(edges)


def _packed(edges: np.ndarray):
    """Packed rows to their bins, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = (_binned(_matrix(batch.column(1)), edges) - np.arange(N_FEATURES) * BINS).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in bins], pa.binary())], ["fold", "bins"])

    return run


def _places(bins: np.ndarray) -> np.ndarray:
    """Bins as places among all features' weights."""
    return bins.astype(np.int64) + np.arange(N_FEATURES) * BINS


def _fold() -> F.Column:
    return F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")


def _train(features: DataFrame, labels: DataFrame, id_col: str, label_col: str, n_positive: int) -> QualityModel | None:
    """Fit on the features (id, x) of all unlabelled documents and of a bounded sample of positives."""
    known = labels.filter(col(label_col).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).cast("bigint").alias("id")).agg(F.min(label_col).alias("label"))
    good = least_by_md5(known.filter("label = 1").select("id"), n_positive)
    texts = features.filter("id IS NOT NULL")
    found = texts.join(F.broadcast(good), "id", "left_semi").toArrow().combine_chunks()
    if not found.num_rows:
        return None
    x = _matrix(found["x"])
    p = x[np.lexsort((*x.T, found["id"].to_numpy()))]
    other, other_path = materialise(texts.join(known.select("id"), "id", "left_anti"), "unlabelled")
    if other.isEmpty():
        return None
    edges = bin_edges(other.select("x").unionByName(texts.join(F.broadcast(good), "id", "left_semi").select("x")))
    tasks = max(1, min(TASKS, -(-other.count() // TASK_ROWS)))
    table, path = materialise(other.select(_fold().alias("fold"), "x").mapInArrow(bw.tidied(_packed(edges)), "fold int, bins binary").repartition(tasks), "bins")
    model = _fit(edges, _binned(p, edges), TableRows(table))
    drop_path(features.sparkSession, path, other_path)
    return model


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bw.bound_batches(docs.sparkSession)
    rows = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).alias("text"))
    return rows.mapInArrow(bw.tidied(_featured), "id bigint, x binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", n_positive: int = N_POSITIVE) -> QualityModel | None:
    """Fit on all unlabelled documents; None without positives or without unlabelled documents."""
    features, _ = materialise(_features(docs, id_col, text_col), "features")
    return _train(features, labels, id_col, label_col, n_positive)


def _score(model: QualityModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = model.score(_matrix(batch.column(1))) if model else np.full(batch.num_rows, np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(_sigmoid(z), 6)), pa.array(z > 0)], ["id", "p", "keep"])

    return run


def quality(docs: DataFrame, labels: DataFrame, model: QualityModel | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, quality_score, keep) for every row."""
    features, _ = materialise(_features(docs, id_col, text_col), "features")
    model = model or _train(features, labels, id_col, label_col, N_POSITIVE)
    return features.mapInArrow(bw.tidied(_score(model)), "id bigint, p double, keep boolean").toDF("doc_id", "quality_score", "keep")
