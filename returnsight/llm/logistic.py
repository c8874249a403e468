"""Ridge logistic regression on a bounded sample (the caller's bound), by Newton steps."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Logistic(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> Logistic:
    """Of one class only, or no rows, the smoothed share of ones for every row."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = x.std(axis=0) if len(x) else np.ones(x.shape[1])
    scale = np.where(scale > 1e-9, scale, 1.0)
    weights = np.zeros(x.shape[1] + 1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    weights[-1] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        penalty = ridge * np.eye(z.shape[1])
        penalty[-1, -1] = 1e-6
        def loss(w: np.ndarray) -> float:
            return float(np.logaddexp(0, z @ w).sum() - y @ (z @ w) + w @ penalty @ w / 2)

        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(z.shape[1]), z.T @ (y - p) - penalty @ weights)
            now, rate = loss(weights), 1.0
            while loss(weights + rate * step) > now and rate > 1e-6:  # full steps overshoot where classes part cleanly
                rate /= 2
            weights = weights + rate * step
            if np.abs(rate * step).max() < 1e-6:
                break
    return Logistic(mean, scale, weights)
