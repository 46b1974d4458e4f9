"""Variable clustering on the correlation matrix, which one pass over the rows gives; all else is done on columns by columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from .regression import moments


def correlations(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    n, sums, cross = moments(df, names)
    cov = cross - np.outer(sums, sums) / n
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    return np.clip(cov / np.where(np.outer(sd, sd) > 0, np.outer(sd, sd), 1), -1, 1)


def linkage(distance: np.ndarray, how: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges (one, other, distance, size) from the nearest on; a merged cluster is numbered after all before. how: average, complete or single."""
    mix = {"average": lambda a, b, m, n: (a * m + b * n) / (m + n), "complete": lambda a, b, m, n: max(a, b), "single": lambda a, b, m, n: min(a, b)}[how]
    apart = {(i, j): float(distance[i, j]) for i in range(len(distance)) for j in range(i + 1, len(distance))}
    size, out = {k: 1 for k in range(len(distance))}, []
    while len(size) > 1:
        i, j = min(apart, key=lambda k: (apart[k], k))
        new = len(distance) + len(out)
        out.append((i, j, apart[i, j], size[i] + size[j]))
        for k in size:
            if k not in (i, j):
                apart[k, new] = mix(apart.pop((min(i, k), max(i, k))), apart.pop((min(j, k), max(j, k))), size[i], size[j])
        del apart[i, j]
        size[new] = size.pop(i) + size.pop(j)
    return out


def least_clusters(corr: np.ndarray, limit: float = 0.6) -> int:
    """Columns that survive when the one with most others above the limit goes, until none has any."""
    left = np.abs(corr) > limit
    np.fill_diagonal(left, False)
    alive = np.ones(len(corr), bool)
    while True:
        degree = (left & alive & alive[:, None]).sum(axis=1)
        if not degree.any():
            return int(alive.sum())
        alive[int(degree.argmax())] = False


class VariableClusters:
    """Clusters of columns by 1 - |correlation|; of each the column of least 1 - r2 ratio (own component against the next best), or of greatest weight, stays.

    fit() sets labels, merges, components (cluster, first and second eigenvalue, share explained), ratios and kept. Rows with a null are left out.
    """

    def __init__(self, n_clusters: int | None = 5, corr_limit: float = 0.6, how: str = "average", weights: dict[str, float] | None = None, keep: Sequence[str] = ()):
        self.n, self.limit, self.how, self.weights, self.keep = n_clusters, corr_limit, how, weights, list(keep)
        self.kept: list[str] | None = None

    def fit(self, df: DataFrame, names: Sequence[str]) -> VariableClusters:
        corr = correlations(df, names)
        self.merges = linkage(1 - np.abs(corr), self.how)
        groups = {k: [k] for k in range(len(names))}
        for step, (i, j, *_) in enumerate(self.merges[: max(0, len(names) - (self.n or least_clusters(corr, self.limit)))]):
            groups[len(names) + step] = groups.pop(i) + groups.pop(j)
        members = sorted((sorted(g) for g in groups.values()), key=lambda g: g[0])
        self.labels = {names[k]: c for c, g in enumerate(members) for k in g}
        axes, self.components = [], []
        for c, g in enumerate(members):
            value, vector = np.linalg.eigh(corr[np.ix_(g, g)])
            axes.append((g, vector[:, -1] / np.sqrt(max(value[-1], 1e-12))))
            self.components.append((c, float(value[-1]), float(value[-2]) if len(g) > 1 else 0.0, float(value[-1] / value.sum())))
        r2 = np.array([[float(corr[k, g] @ v) ** 2 for g, v in axes] for k in range(len(names))])
        self.ratios = {}
        for k, n in enumerate(names):
            own, rest = r2[k, self.labels[n]], np.delete(r2[k], self.labels[n])
            self.ratios[n] = float((1 - own) / max(1 - (rest.max() if len(rest) else 0.0), 1e-12))
        order = (lambda n: (-self.weights[n], n)) if self.weights else (lambda n: (self.ratios[n], n))
        best = {min((names[k] for k in g), key=order) for g in members}
        self.kept = [n for n in names if n in best or n in self.keep]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.kept is None:
            raise RuntimeError("fit() comes first")
        return df.select(*self.kept)
