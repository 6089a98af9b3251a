"""Logistic regression with lasso and ridge terms, by accelerated proximal gradient steps, for samples of bounded size."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, lasso: float = 0.0, ridge: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept for the mean log loss plus lasso * |w| plus ridge / 2 * w^2. The intercept is free."""
    x, y = np.asarray(x, np.float32), np.asarray(y, np.float32)
    n, d = x.shape
    rate = float(y.mean()) if n else 0.5
    if n == 0 or rate in (0.0, 1.0):
        return np.zeros(d, np.float32), float(np.clip(np.log((rate + 1e-3) / (1 - rate + 1e-3)), -6, 6))
    # The largest eigenvalue of x'x / n, by power steps, bounds the curvature.
    v = np.ones(d + 1, np.float32)
    for _ in range(12):
        u = x @ v[:d] + v[d]
        v = np.append(x.T @ u, u.sum()) / n
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    step = 1 / (0.25 * top * 1.05 + ridge)
    w = z = np.zeros(d + 1, np.float32)
    w[d] = np.log(rate / (1 - rate))
    t = 1.0
    for _ in range(steps):
        error = sigmoid(x @ z[:d] + z[d]) - y
        gradient = np.append(x.T @ error / n + ridge * z[:d], error.mean())
        new = (z - step * gradient).astype(np.float32)
        new[:d] = np.sign(new[:d]) * np.maximum(np.abs(new[:d]) - step * lasso, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + np.float32((t - 1) / t_new) * (new - w)
        w, t = new, t_new
    return w[:d], float(w[d])
