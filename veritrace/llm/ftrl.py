"""Follow-the-regularised-leader (proximal) with elastic-net penalties, for sparse rows."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate FTRL-proximal for `classes` outputs (1: logistic, more: softmax).

    w = 0 where |z| <= l1, else -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2).
    The last row of the tables is the bias, which is not penalised.
    """

    def __init__(self, size: int, classes: int = 1, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01):
        self.size, self.classes = size, classes
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((size + 1, classes), np.float32), np.zeros((size + 1, classes), np.float32)

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        if isinstance(rows, slice) or rows[-1] == self.size:
            w[-1] = -z[-1] * self.alpha / (self.beta + np.sqrt(n[-1]))
        return w

    def fit(self, data: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 2, seed: int = 0) -> Ftrl:
        """data: (indices, values, class) of each row; a row's indices are distinct."""
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(data)):
                index, value, label = data[k]
                index, value = np.append(index, self.size).astype(np.int64), np.append(value, 1.0)
                w = self.weights(index)
                logits = value @ w
                p = _softmax(logits) if self.classes > 1 else 1 / (1 + np.exp(-np.clip(logits, -35, 35)))
                error = p.copy()
                if self.classes > 1:
                    error[label] -= 1
                else:
                    error -= label
                g = value[:, None] * error
                n = self.n[index]
                grown = n + g * g
                self.z[index] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
                self.n[index] = grown
        return self


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def softmax(x: np.ndarray) -> np.ndarray:
    return _softmax(x)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that minimises the negative log-likelihood of labels, by golden section on its logarithm."""
    if not len(labels):
        return 1.0
    rows = np.arange(len(labels))

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(logits / np.exp(t))[rows, labels], 1e-300)).mean())

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
