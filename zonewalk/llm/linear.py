"""Linear models over sparse rows, fitted on the driver from a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from zonewalk.llm.common import flat_values, starts_of

BLOCK = 1 << 20


@dataclass
class Rows:
    """Sparse rows: row i has the columns at[begins[i]:begins[i+1]] with their values."""

    begins: np.ndarray
    at: np.ndarray
    values: np.ndarray
    dims: int

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]], dims: int) -> Rows:
        begins = np.concatenate(([0], np.cumsum([len(a) for a, _ in rows]))).astype(np.int64)
        at = np.concatenate([a for a, _ in rows] or [np.zeros(0, np.int32)])
        return Rows(begins, at, np.concatenate([v for _, v in rows] or [np.zeros(0, np.float32)]), dims)

    @staticmethod
    def held(table: pa.Table, dims: int) -> Rows:
        """From a table without further copies: columns `at` and `val` hold the numbers of each row as bytes."""
        (at, n), (values, _) = (flat_values(table.column(c).chunk(0), dtype) for c, dtype in (("at", "<i4"), ("val", "<f4")))
        return Rows(starts_of(n), at, values, dims)

    def pick(self, which: np.ndarray) -> Rows:
        return Rows.of([(self.at[a:b], self.values[a:b]) for a, b in zip(self.begins[which], self.begins[which + 1])], self.dims)

    def _blocks(self) -> Iterator[tuple[int, int, slice]]:
        """Runs of rows [a, b) with their values, about BLOCK values each, so that nothing as large as the rows is copied."""
        a, n = 0, len(self.begins) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.begins, self.begins[a] + BLOCK, side="right")) - 1)
            yield a, b, slice(int(self.begins[a]), int(self.begins[b]))
            a = b

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.begins) - 1)
        for a, b, own in self._blocks():
            total = np.concatenate(([0.0], np.cumsum(w[self.at[own]] * self.values[own], dtype=np.float64)))
            edges = self.begins[a : b + 1] - self.begins[a]
            out[a:b] = total[edges[1:]] - total[edges[:-1]]
        return out

    def transposed(self, per_row: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dims)
        for a, b, own in self._blocks():
            out += np.bincount(self.at[own], weights=np.repeat(per_row[a:b], np.diff(self.begins[a : b + 1])) * self.values[own], minlength=self.dims)
        return out

    def scale(self) -> np.ndarray:
        """Per column 1 / sqrt(mean value), so that rare columns weigh in; 0 for columns without values."""
        mean = self.transposed(np.ones(len(self.begins) - 1)) / max(len(self.begins) - 1, 1)
        return np.divide(1.0, np.sqrt(mean), out=np.zeros(self.dims), where=mean > 0)

    def scaled(self, by: np.ndarray) -> Rows:
        return Rows(self.begins, self.at, self.values * by.astype(np.float32)[self.at], self.dims)


def adam(grad, size: int, steps: int, rate: float) -> np.ndarray:
    """Minimise by Adam with full gradients; grad(x) gives the gradient."""
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(x)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        x -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def svm(rows: Rows, sign: np.ndarray, l2: float = 1e-4, steps: int = 60, rate: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear support vector machine with squared hinge loss; signs are -1 or 1, classes weigh the same."""
    weight = np.where(sign > 0, 0.5 / max((sign > 0).mean(), 1e-9), 0.5 / max((sign < 0).mean(), 1e-9)) / len(sign)

    def grad(x: np.ndarray) -> np.ndarray:
        slack = np.maximum(0, 1 - sign * (rows.times(x[:-1]) + x[-1]))
        g = -2 * weight * sign * slack
        return np.append(rows.transposed(g) + l2 * x[:-1], g.sum())

    x = adam(grad, rows.dims + 1, steps, rate)
    return x[:-1], float(x[-1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def ordinal(rows: Rows, grade: np.ndarray, grades: int, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 120, rate: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of a cumulative-link model, P(grade <= k) = sigmoid(threshold[k] - weights x)."""
    d, n = rows.dims, len(grade)
    weight = np.ones(n) if weight is None else weight
    below = np.bincount(grade, weights=weight, minlength=grades).cumsum()[:-1]
    start = np.log((below + 0.5) / (weight.sum() - below + 0.5))

    def cuts(x: np.ndarray) -> np.ndarray:
        """The first threshold is free, each gap is a positive number; x is relative to the marginal start."""
        gaps = np.exp(np.log(np.maximum(np.diff(start), 1e-3)) + x[d + 1 :])
        return np.concatenate(([start[0] + x[d]], start[0] + x[d] + np.cumsum(gaps)))

    def grad(x: np.ndarray) -> np.ndarray:
        theta, s = cuts(x), rows.times(x[:d])
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        a, b = sigmoid(edge[grade + 1] - s), sigmoid(edge[grade] - s)
        p = np.maximum(a - b, 1e-12)
        up, low = np.where(grade < grades - 1, -a * (1 - a) / p, 0) * weight, np.where(grade > 0, b * (1 - b) / p, 0) * weight
        by_cut = np.bincount(np.minimum(grade, grades - 2), weights=np.where(grade < grades - 1, up, 0), minlength=grades - 1) + np.bincount(np.maximum(grade - 1, 0), weights=low, minlength=grades - 1)
        later = np.cumsum(by_cut[::-1])[::-1]
        return np.concatenate((rows.transposed((1 - a - b) * weight / n) + l2 * x[:d], later[:1] / n, later[1:] * np.diff(theta) / n))

    x = adam(grad, d + grades - 1, steps, rate)
    return x[:d], cuts(x)
