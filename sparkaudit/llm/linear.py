"""Logistic regression on arrays, for bounded training samples."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def newton(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25,
           intercept: bool = True) -> np.ndarray:
    """Weights (the intercept last, if any, without penalty) that minimise logistic loss + penalty/2 |w|^2."""
    if intercept:
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    ridge = np.full(x.shape[1], penalty)
    if intercept:
        ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + ridge * w
        curvature = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Bins(NamedTuple):
    """Quantile bins per feature: a monotone-free, bounded expansion for linear models."""

    edges: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, n: int) -> Bins:
        return cls([np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """One 0/1 column per inner edge and feature: whether the value lies beyond the edge."""
        return np.hstack([(c[:, None] > e).astype(np.float32) for c, e in zip(x.T, self.edges, strict=True)])
