"""Logistic regression with numpy, for the few dozen features that operators train on."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, p: np.ndarray, l2: float = 1e-3, steps: int = 40, towards: np.ndarray | None = None) -> np.ndarray:
    """Coefficients, the constant first, that fit probabilities p, by damped Newton steps; drawn to `towards` (or 0)."""
    x = np.c_[np.ones(len(x)), x]
    centre = np.zeros(x.shape[1]) if towards is None else towards
    b = centre.copy()
    ridge = l2 * len(x) * np.eye(x.shape[1])
    ridge[0, 0] = 1e-9
    for _ in range(steps):
        q = sigmoid(x @ b)
        step = np.linalg.solve((x * (q * (1 - q) + 1e-6)[:, None]).T @ x + ridge, x.T @ (p - q) - ridge @ (b - centre))
        b += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return b
