"""Quality scores by regularised quadratic discriminant analysis (operator 8).

A document becomes a vector of transformed statistics of its words, characters and lines. Each class has a Gaussian whose
covariance is shrunk towards its diagonal and floored; its Cholesky factor is computed once and cached in the model. The score
is the difference of the two log densities, each a Mahalanobis distance and a log determinant, put on a probability scale
by a logistic fit on the other half of the sample. Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .labelled import bucket, labelled_sample

#: Labelled rows that a fit takes at most.
FIT_ROWS = 20_000

_CLASS = np.full(256, 7, np.uint8)  # 7: part of a character beyond ASCII
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:'\"?()-")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[[c for c in range(128) if _CLASS[c] == 7]] = 6  # other ASCII marks


def statistics(text: str | None) -> list[float]:
    """The transformed statistics; an empty or null text has those of no words."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    words = (text or "").split()
    n, b = max(len(words), 1), max(len(raw), 1)
    cls = _CLASS[raw]
    kinds = np.bincount(cls, minlength=8)
    letters = max(int(kinds[0] + kinds[1] + kinds[7]), 1)
    mark = cls >= 5
    twice = int(((raw[1:] == raw[:-1]) & mark[1:] & (cls[1:] != 7)).sum())
    counts = np.fromiter(Counter(words).values(), float) if words else np.ones(1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    same = sum(map(operator.eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = (text or "").split("\n")
    share = counts / counts.sum()
    root = lambda x: float(np.sqrt(x))
    return [
        float(np.log1p(len(words))),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        float(np.log1p(lengths.max())),
        root(kinds[1] / letters),
        root(kinds[2] / b),
        root(kinds[5] / n),
        root(kinds[6] / n),
        root(twice / n),
        root(same / n),
        len(counts) / n**0.9,
        pairs / n,
        root(counts.max() / n),
        float(-(share * np.log(share)).sum() / np.log(n + 1)),
        float(np.log1p(n / len(lines))),
        len(set(lines)) / len(lines),
        root(kinds[7] / b),
        root(float(kinds[4]) / n),
    ]


@dataclass
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # the inverse of the covariance's Cholesky factor
    log_det: float

    @classmethod
    def fit(cls, x: np.ndarray, shrink: float, floor: np.ndarray) -> Gaussian:
        mean = x.mean(0)
        s = np.cov(x.T, bias=True) if len(x) > 1 else np.zeros((x.shape[1],) * 2)
        s = (1 - shrink) * s + shrink * np.diag(np.diag(s)) + np.diag(floor)
        lower = np.linalg.cholesky(s)
        return cls(mean, np.linalg.inv(lower), 2 * float(np.log(np.diag(lower)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.factor.T
        return -0.5 * ((z * z).sum(1) + self.log_det)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression, the last one the constant, by Newton's method with halved steps."""
    x = np.column_stack([x, np.ones(len(x))])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (keep * w * w).sum()

    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        t = 1.0
        while t > 1e-4 and loss(w - t * step) > loss(w):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return w


@dataclass
class QualityModel:
    good: Gaussian | None
    bad: Gaussian | None
    center: np.ndarray
    scale: np.ndarray
    line: np.ndarray
    prior: float

    def scores(self, texts: list) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([statistics(t) for t in texts])
        if self.good is None:
            return np.full(len(x), self.prior)
        u = np.column_stack([self.features(x), np.ones(len(x))]) @ self.line
        return 1 / (1 + np.exp(-np.clip(u, -40, 40)))

    def features(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.center) / self.scale
        d = self.good.log_density(x) - self.bad.log_density(x)
        return np.column_stack([np.arcsinh(d), np.clip(d, -20, 20)])


def fit(x: np.ndarray, y: np.ndarray, half: np.ndarray, shrink: float = 0.1) -> QualityModel:
    """Gaussians from half 0, the probability scale from half 1. With a class missing, all texts get the share of label 1."""
    prior = float((y.sum() + 1) / (len(y) + 2))
    a, b = half == 0, half == 1
    if min([int((y[h] == c).sum()) for h in (a, b) for c in (0, 1)], default=0) < 5:
        return QualityModel(None, None, np.zeros(1), np.ones(1), np.zeros(3), prior)
    center, scale = x[a].mean(0), x[a].std(0) + 1e-6
    z = (x[a] - center) / scale
    floor = np.full(x.shape[1], 1e-2)
    model = QualityModel(*(Gaussian.fit(z[y[a] == c], shrink, floor) for c in (1, 0)), center, scale, np.zeros(3), prior)
    model.line = logistic(model.features(x[b]), y[b].astype(float))
    return model


def quality_model(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fold: int = 0, at_most: int = FIT_ROWS) -> QualityModel:
    """A model from about `at_most` labelled rows outside the held-out fold; the driver holds their statistics only."""
    sample = labelled_sample(docs, labels, label_col, held_out=lambda c: bucket(c, folds) == fold, at_most=at_most, id_col=id_col, text_col=text_col)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = [statistics(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "label", "half"])

    rows = sorted((r["x"], r["label"], r["half"]) for r in sample.mapInArrow(run, "x array<double>, label int, half int").collect())
    x = np.array([r[0] for r in rows]).reshape(len(rows), len(rows[0][0]) if rows else 1)
    return fit(x, np.array([r[1] for r in rows], int), np.array([r[2] for r in rows], int))


def score_column(model, text: Column) -> Column:
    """The score of a text column, by a model with scores(texts)."""
    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series(model.scores(t.tolist()))

    return score(F.coalesce(text, F.lit("")))


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fold: int = 0, threshold: float = 0.3, at_most: int = FIT_ROWS) -> DataFrame:
    """docs -> (id, held_out, score, predicted), one row per input row.

    Null texts score as empty ones. A null id is never held out. With too few labels of a class the score is the share
    of label 1 among those there are, and 0.5 without any. Repeated rows repeat; an empty table gives none.
    """
    model = quality_model(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, fold=fold, at_most=at_most)
    return scored(docs, model, id_col, text_col, folds, fold, threshold)


def scored(docs: DataFrame, model, id_col: str, text_col: str, folds: int, fold: int, threshold: float) -> DataFrame:
    rows = docs.select(F.col(id_col), F.coalesce(bucket(id_col, folds) == fold, F.lit(False)).alias("held_out"), score_column(model, F.col(text_col)).alias("score"))
    return rows.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
