"""Quality by ordinal cumulative-link regression on graded ratings: shared weights, ordered thresholds."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_fold
from .hashed import Adam, learned_terms, matrix, rows_of, sample, sigmoid, style, tables


def grade() -> Column:
    """Rating of a labelled row: 0 for bad quality, 1 for good but toxic, 2 for good."""
    good = F.col("quality")
    return F.when(good.isNotNull(), good * (F.lit(2) - F.coalesce("toxic", F.lit(0))))


@dataclass
class Ordinal:
    """P(grade <= k) = sigmoid(threshold k - sum of weights): the thresholds rise, the weights are shared."""

    terms: np.ndarray
    weights: np.ndarray
    low: np.ndarray  # first threshold and the logarithms of the gaps

    def thresholds(self):
        return np.concatenate([self.low[:1], self.low[0] + np.cumsum(np.exp(self.low[1:]))])

    def below(self, rows, cols, vals, n):
        """P(grade <= k) for each row and threshold."""
        raw = np.bincount(rows, self.weights[cols] * vals, n)
        return sigmoid(self.thresholds()[None, :] - raw[:, None])

    def fit(self, rows, cols, vals, y, steps, penalty):
        n, k = len(y), len(self.terms)
        adam = Adam([self.weights, self.low])
        for _ in range(steps):
            c = self.below(rows, cols, vals, n)
            whole = np.concatenate([np.zeros((n, 1)), c, np.ones((n, 1))], axis=1)
            slope = np.concatenate([np.zeros((n, 1)), c * (1 - c), np.zeros((n, 1))], axis=1)
            i = np.arange(n)
            p = np.maximum(whole[i, y + 1] - whole[i, y], 1e-9)
            # d(-log p): by the raw score, then by each threshold
            raw = (slope[i, y + 1] - slope[i, y]) / p / n
            by = np.zeros((n, c.shape[1] + 2))
            by[i, y + 1] -= slope[i, y + 1] / p / n
            by[i, y] += slope[i, y] / p / n
            steps_ = by[:, 1:-1].sum(axis=0)
            gaps = np.exp(self.low[1:]) * np.cumsum(steps_[::-1])[::-1][1:]
            adam.step([np.bincount(cols, raw[rows] * vals, k) + penalty * self.weights, np.concatenate([[steps_.sum()], gaps])])
        return self


def train(docs: DataFrame, labels: DataFrame, grades: int = 3, steps: int = 250, penalty: float = 1e-5) -> Ordinal:
    """Learn ``grade()`` from a bounded sample (``hashed.TRAIN_ROWS`` rows) of labelled documents outside the held-out
    fold.  Without labels of at least two grades no weight is learned and every document gets the top grade."""
    rows = sample(docs, labels, grade())
    terms = learned_terms(rows, style, grades - 1)
    at, cols, vals, y = matrix(rows, style, terms)
    first = np.concatenate([[-2.0], np.zeros(grades - 2)]) if len(terms) else np.concatenate([[-20.0], np.zeros(grades - 2)])
    model = Ordinal(terms, np.zeros(len(terms)), first)
    return model.fit(at, cols, vals, y, steps, penalty) if len(terms) else model


def score(docs: DataFrame, model: Ordinal, least: int = 1) -> DataFrame:
    """``docs`` with ``held_out``, ``expected_grade``, ``tail`` = P(grade >= least) and ``kept`` (tail >= 0.5) of each
    whole text.

    Null and empty texts are scored by the terms of an empty text.  Rows with a null id are scored and not held out;
    repeated rows are scored alike, an empty table gives no rows, and columns of the four names are replaced.
    """
    @F.pandas_udf("struct<expected:double,tail:double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        cuts, cols, vals = rows_of(texts.tolist(), style, tables(style), model.terms)
        c = model.below(np.repeat(np.arange(len(texts)), np.diff(cuts)), cols, vals, len(texts))
        return pd.DataFrame({"expected": (1 - c).sum(axis=1), "tail": 1 - c[:, least - 1]})

    scored = docs.withColumn("held_out", in_fold("doc_id")).withColumn("_of", of(F.col("text")))
    return scored.withColumns({"expected_grade": F.col("_of.expected"), "tail": F.col("_of.tail"),
                               "kept": F.col("_of.tail") >= 0.5}).drop("_of")
