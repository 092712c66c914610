"""Toxicity by a factorization machine over hashed words and word beginnings."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold
from .hashed import Adam, learned_terms, matrix, presence, rows_of, sample, sigmoid, tables


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of terms of the product of their factors)."""

    terms: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows, cols, vals, n):
        return sigmoid(self._parts(rows, cols, vals, n)[0])

    def _parts(self, rows, cols, vals, n):
        line = np.bincount(rows, self.weights[cols] * vals, n)
        sums = np.stack([np.bincount(rows, f[cols] * vals, n) for f in self.factors.T], axis=1)
        squares = np.bincount(rows, ((self.factors[cols] ** 2).sum(axis=1) * vals ** 2), n)
        return self.bias[0] + line + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums

    def fit(self, rows, cols, vals, y, steps, penalty):
        n, k = len(y), len(self.terms)
        adam = Adam([self.bias, self.weights, self.factors])
        for _ in range(steps):
            raw, sums = self._parts(rows, cols, vals, n)
            slope = (sigmoid(raw) - y) / n
            at = slope[rows] * vals
            pair = sums[rows] - self.factors[cols] * vals[:, None]
            steep = np.stack([np.bincount(cols, at * p, k) for p in pair.T], axis=1)
            adam.step([np.array([slope.sum()]), np.bincount(cols, at, k) + penalty * self.weights,
                       steep + penalty * self.factors])
        return self


def train(docs: DataFrame, labels: DataFrame, factors: int = 4, steps: int = 150, penalty: float = 1e-5) -> Machine:
    """Learn ``labels.toxic`` from the texts of a bounded sample (``hashed.TRAIN_ROWS`` rows) outside the held-out fold.
    Without both kinds of labels the machine has its bias only: the share of toxic rows, 0 without any."""
    rows = sample(docs, labels, F.lit(1) - F.col("toxic"))  # grade 0: toxic
    terms = learned_terms(rows, presence, 1)
    at, cols, vals, grades = matrix(rows, presence, terms)
    y = (grades == 0).astype(float)
    mean = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
    start = np.random.default_rng(11).normal(0, 0.05, (len(terms), factors))
    machine = Machine(terms, np.array([np.log(mean / (1 - mean))]), np.zeros(len(terms)), start)
    return machine.fit(at, cols, vals, y, steps, penalty) if len(terms) else machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` of each whole text.

    Null and empty texts have no terms and get the score of the bias.  Rows with a null id are scored and not held out;
    repeated rows are scored alike, an empty table gives no rows, and columns of the three names are replaced.
    """
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        cuts, cols, vals = rows_of(texts.tolist(), presence, tables(presence), machine.terms)
        return pd.Series(machine.scores(np.repeat(np.arange(len(texts)), np.diff(cuts)), cols, vals, len(texts)))

    scored = docs.withColumn("held_out", in_fold("doc_id")).withColumn("score", of(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
