"""Principal components from one distributed Gram matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .vectors import totals, width, with_rows


@dataclass(frozen=True)
class Components:
    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray  # components in rows
    variance_ratio: np.ndarray  # of all components
    names: tuple[str, ...] = ()

    @property
    def k(self) -> int:
        return len(self.axes)

    def transform(self, rows: DataFrame, name: str = "pc") -> DataFrame:
        mean, scale, axes = self.mean, self.scale, self.axes
        return with_rows(rows, lambda x: ((x - mean) / scale) @ axes.T, name)

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.axes.T

    def inverse(self, z: np.ndarray) -> np.ndarray:
        return (z @ self.axes[: z.shape[1]]) * self.scale + self.mean

    def variance_table(self) -> list[tuple[int, float, float]]:
        """(component, share, cumulative share) of every component."""
        return [(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(self.variance_ratio, np.cumsum(self.variance_ratio)))]

    def loadings(self, top: int = 10) -> list[tuple[str, str, float]]:
        """(component, feature, loading), the largest by size of each component."""
        label = self.names or tuple(f"x{i}" for i in range(self.axes.shape[1]))
        return [(f"PC{i + 1}", label[j], float(a[j])) for i, a in enumerate(self.axes) for j in np.argsort(-np.abs(a), kind="stable")[:top]]

    def dominance(self, components: int = 10) -> list[tuple[str, float]]:
        """Features by their loadings' sizes, weighted by the components' shares."""
        label = self.names or tuple(f"x{i}" for i in range(self.axes.shape[1]))
        score = self.variance_ratio[: min(components, self.k)] @ np.abs(self.axes[:components])
        return sorted(zip(label, map(float, score)), key=lambda p: -p[1])


def center_features(pca: Components, centers: np.ndarray, top: int = 20) -> list[dict]:
    """Features of each centre, a point among the components, mapped back: the largest by size, the largest and the smallest.

    One entry (cluster, ranking, nth, feature, standardised, original) each;
    ``ranking`` is absolute, positive or negative, of which the last two hold
    values of that sign only.  Equal values go by the features' order.
    """
    names = pca.names or tuple(f"x{i}" for i in range(pca.axes.shape[1]))
    out = []
    for j, z in enumerate(np.asarray(centers, float)):
        value = z @ pca.axes[: len(z)]
        original = value * pca.scale + pca.mean
        for ranking, key, kept in (("absolute", -np.abs(value), value == value), ("positive", -value, value > 0), ("negative", value, value < 0)):
            order = [i for i in np.argsort(key, kind="stable") if kept[i]][:top]
            out += [{"cluster": j, "ranking": ranking, "nth": n + 1, "feature": names[i], "standardised": float(value[i]), "original": float(original[i])} for n, i in enumerate(order)]
    return out


def covariance_ellipses(pca: Components, centers: np.ndarray, covariances: np.ndarray, deviations: float = 2.0) -> list[dict]:
    """The ellipse of each cluster in the plane of the first two components: its centre, full axes and angle in degrees.

    Covariances are projected by the components; the long axis lies at
    ``angle``, in (-90, 90], against the first component.
    """
    axes, out = pca.axes[:2], []
    for j, (v, c) in enumerate(zip(np.asarray(centers, float), np.asarray(covariances, float))):
        scaled = c / np.outer(pca.scale, pca.scale)
        values, vectors = np.linalg.eigh(axes @ scaled @ axes.T)
        values = np.maximum(values[::-1], 1e-10)
        angle = np.degrees(np.arctan2(vectors[1, -1], vectors[0, -1]))
        angle += 180 if angle <= -90 else -180 if angle > 90 else 0
        x, y = pca.project(v[None, :])[0][:2]
        out.append({"cluster": j, "x": float(x), "y": float(y), "width": float(2 * deviations * np.sqrt(values[0])), "height": float(2 * deviations * np.sqrt(values[1])), "angle": float(angle)})
    return out


def fit_pca(rows: DataFrame, n_components: float = 0.9, max_components: int | None = 20, standardise: bool = False, names: tuple[str, ...] = ()) -> Components:
    """Components of the vectors ``x``: a number in (0, 1] is the share of variance to reach, else a count.

    An axis points where its largest loading is positive.
    """
    d = width(rows)
    if not d:
        raise ValueError("no rows to reduce")

    first = totals(rows, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    n, mean = first[0], first[1 : d + 1] / first[0]
    spread = np.sqrt(np.maximum(first[d + 1 :] / n - mean**2, 0))
    scale = np.where(spread > 1e-12, spread, 1.0) if standardise else np.ones(d)
    gram = totals(rows, lambda x: (lambda z: z.T @ z)((x - mean) / scale), d * d).reshape(d, d)
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    ratio = values / values.sum() if values.sum() > 0 else np.zeros(d)
    if isinstance(n_components, float) and 0 < n_components <= 1:
        k = int(np.searchsorted(np.cumsum(ratio), n_components - 1e-12) + 1)
    else:
        k = int(n_components)
    k = max(1, min(k, d, max_components or d))
    axes = vectors[:k] * np.sign(vectors[np.arange(k), np.abs(vectors[:k]).argmax(1)])[:, None]
    return Components(mean, scale, axes, ratio, names)
