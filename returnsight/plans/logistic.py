"""Logistic regressions of all folds and data sets at once.

Every row trains the models of its data set whose fold is not its own. A pass over the rows gives all
models' losses, gradients and Hessians in one aggregation; the driver, which holds one small matrix a
model, takes a Newton step for each, halved where the last one did not lower the loss. The objective
is the summed log-loss plus half the squared weights (C = 1), the intercept free. Missing predictors
count as the model's training mean. What is held grows with models x columns squared, not with rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnsight.functions import nan_to_null, ship_by_value

ship_by_value(__name__)

#: Steps at most, and the gradient, as a share of the training rows, at which a model is done.
MAX_STEPS, TOLERANCE = 25, 1e-10


@dataclass
class FoldModels:
    """Models of every (data set, fold); ``passes`` counts the reads of the rows while fitting."""

    names: list[str]
    n_folds: int
    cols: list[str]
    means: np.ndarray  # models x columns
    weights: np.ndarray  # models x (intercept, columns)
    passes: int = field(default=0)

    def number(self, name: str, fold: int) -> int:
        return self.names.index(name) * self.n_folds + fold


def _design(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.where(np.isnan(x), means, x)])


def _sums(models: FoldModels, open_models: list[int]):
    """Tasks over (dataset, fold, label, columns): per open model loss, gradient and Hessian (upper
    triangle) as rows (model, place, value)."""
    width, n_folds = len(models.cols) + 1, models.n_folds
    upper = np.triu_indices(width)

    def run(batches):
        sums = {m: np.zeros(1 + width + len(upper[0])) for m in open_models}
        for batch in batches:
            dataset, fold, y, *x = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns))
            x = np.column_stack(x).astype(float)
            for m, own in sums.items():
                rows = (dataset == m // n_folds) & (fold != m % n_folds)
                if not rows.any():
                    continue
                a, labels = _design(x[rows], models.means[m]), y[rows]
                margin = a @ models.weights[m]
                p = 0.5 * (1 + np.tanh(margin / 2))
                own[0] += (np.logaddexp(0, margin) - labels * margin).sum()
                own[1 : width + 1] += a.T @ (p - labels)
                own[width + 1 :] += (a.T @ (a * (p * (1 - p))[:, None]))[upper]
        size = 1 + width + len(upper[0])
        model = np.repeat(np.array(list(sums), np.int32), size)
        place = np.tile(np.arange(size, dtype=np.int32), len(sums))
        yield pa.RecordBatch.from_arrays([pa.array(model), pa.array(place), pa.array(np.concatenate([*sums.values(), []]))], ["model", "place", "value"])

    return run


def fit_folds(rows: DataFrame, names: Sequence[str], cols: Sequence[str], n_folds: int) -> FoldModels:
    """Fit on ``rows`` (``dataset`` as a number in ``names``, ``fold``, ``label`` and the columns), a
    written table. A training set of one class gives an intercept of plus or minus infinity."""
    cols, names, width = list(cols), list(names), len(cols) + 1
    clean = _clean(rows, cols)
    per_fold = clean.groupBy("dataset", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"),
        *[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(cols) for f in (F.sum, F.count)],
    ).collect()  # a row per data set and fold
    stats = np.zeros((len(names), n_folds, 2 + 2 * len(cols)))
    for r in per_fold:
        stats[r["dataset"], r["fold"]] = [r["n"], r["positives"], *(r[f"sum{i}"] or 0.0 for i in range(len(cols))), *(r[f"count{i}"] for i in range(len(cols)))]
    training = (stats.sum(axis=1, keepdims=True) - stats).reshape(len(names) * n_folds, -1)
    n, positives = training[:, 0], training[:, 1]
    total, present = training[:, 2 : 2 + len(cols)], training[:, 2 + len(cols) :]
    models = FoldModels(names, n_folds, cols, np.divide(total, present, out=np.zeros_like(total), where=present > 0), np.zeros((len(n), width)), 1)
    mixed = (positives > 0) & (positives < n)
    models.weights[~mixed, 0] = np.where(positives[~mixed] > 0, np.inf, -np.inf)
    open_models = np.flatnonzero(mixed).tolist()
    share = positives[mixed] / n[mixed]
    models.weights[mixed, 0] = np.log(share / (1 - share))
    upper, ridge = np.triu_indices(width), np.diag(np.r_[0.0, np.ones(len(cols))])
    best: dict[int, tuple[np.ndarray, float]] = {}
    for _ in range(MAX_STEPS):
        if not open_models:
            break
        summed = clean.mapInArrow(_sums(models, open_models), "model int, place int, value double").groupBy("model", "place").agg(F.sum("value").alias("value")).collect()
        models.passes += 1
        sums = {m: np.zeros(1 + width + len(upper[0])) for m in open_models}
        for r in summed:
            sums[r["model"]][r["place"]] = r["value"]
        for m, own in sums.items():
            w = models.weights[m]
            loss = own[0] + 0.5 * float(w[1:] @ w[1:])
            if m in best and loss > best[m][1] * (1 + 1e-12) + 1e-12:
                models.weights[m] = (w + best[m][0]) / 2
                continue
            best[m] = (w.copy(), loss)
            gradient = own[1 : width + 1] + ridge @ w
            if np.abs(gradient).max() <= TOLERANCE * n[m]:
                open_models.remove(m)
                continue
            hessian = np.zeros((width, width))
            hessian[upper] = own[width + 1 :]
            hessian = np.triu(hessian) + np.triu(hessian, 1).T + ridge
            models.weights[m] = w - np.linalg.lstsq(hessian, gradient, rcond=None)[0]
    for m in open_models:
        models.weights[m] = best[m][0]
    return models


def _clean(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    x = [nan_to_null(F.col(c).cast("double")).alias(c) for c in cols]
    return rows.select(F.col("dataset").cast("int"), F.col("fold").cast("int"), F.col("label").cast("double"), *x)


def _hits(models: FoldModels):
    def run(batches):
        hits, n = np.zeros(len(models.weights), np.int64), np.zeros(len(models.weights), np.int64)
        for batch in batches:
            dataset, fold, y, *x = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns))
            x, model = np.column_stack(x).astype(float), dataset.astype(np.int64) * models.n_folds + fold
            a = np.where(np.isnan(x), models.means[model], x)
            margin = models.weights[model, 0] + np.einsum("ij,ij->i", a, models.weights[model, 1:])
            np.add.at(hits, model, (margin > 0) == (y == 1))
            np.add.at(n, model, 1)
        model = np.flatnonzero(n).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(model), pa.array(hits[model]), pa.array(n[model])], ["model", "hits", "n"])

    return run


def held_out_accuracy(rows: DataFrame, models: FoldModels) -> dict[str, list[float]]:
    """Each data set's accuracies, fold by fold, of the model that has not seen the fold: one pass."""
    scored = _clean(rows, models.cols).mapInArrow(_hits(models), "model int, hits long, n long").groupBy("model").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    share = {r["model"]: r["hits"] / r["n"] for r in scored.collect()}
    return {name: [share[models.number(name, k)] for k in range(models.n_folds)] for name in models.names}
