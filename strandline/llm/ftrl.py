"""Follow-the-regularised-leader for (multinomial) logistic regression on sparse rows, with elastic net."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """FTRL-proximal with per-coordinate rates; coordinate state is (features + 1, outputs), the last row the intercepts."""

    def __init__(self, features: int, outputs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.z = np.zeros((features + 1, outputs))
        self.n = np.zeros((features + 1, outputs))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, ids: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def step(self, ids: np.ndarray, x: np.ndarray, target: np.ndarray, predict) -> None:
        """One update from the row with values x at ids; ``predict`` maps margins to probabilities."""
        ids, x = np.append(ids, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(ids)
        g = x[:, None] * (predict(x @ w) - target)[None, :]
        n = self.n[ids]
        more = n + g * g
        self.z[ids] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = more


def sigmoid(m):
    return 1.0 / (1.0 + np.exp(-np.clip(m, -40, 40)))


def softmax(m):
    e = np.exp(m - np.max(m, axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
