"""Soft and crisp clustering of vector rows.

Centres and covariances are small and live on the driver; every iteration is
one pass of ``totals`` over the rows, so memory and driver traffic do not
depend on their number.  ``rows`` has ``id`` and ``x``; keep it cached or
written, as it is read once an iteration.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import argmax_label, packed, squared_distances, totals, with_rows

NEAR = 1e-12


@dataclass
class Clusters:
    """A fitted model.  ``assign`` gives degrees and labels of any rows."""

    method: str
    centers: np.ndarray
    objective: float
    iterations: int
    converged: bool
    seed: int | None = None
    m: float = 2.0
    extras: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        """What travels to tasks: everything but the frames."""
        return self.__dict__ | {"extras": {n: v for n, v in self.extras.items() if not isinstance(v, DataFrame)}}

    @property
    def k(self) -> int:
        return len(self.centers)

    @property
    def fuzzy(self) -> bool:
        return self.method in ("fcm", "pfcm", "gk")

    def degrees(self, x: np.ndarray) -> np.ndarray:
        if self.method == "gk":
            return memberships(mahalanobis(x, self.centers, self.extras["norms"]), self.m)
        d2 = squared_distances(x, self.centers)
        return memberships(d2, self.m) if self.fuzzy else np.eye(self.k)[d2.argmin(1)]

    def assign(self, rows: DataFrame) -> DataFrame:
        """(..., u array<double>, label int).

        Rows that an agglomeration has seen get the label of its tree, others that of the nearest centre.
        """
        if "leaves" in self.extras:
            known = rows.join(self.extras["leaves"], "x", "left").select(*rows.columns, "leaf_label")
            label = F.coalesce("leaf_label", argmax_label(F.col("u")))
            v = self.centers
            out = with_rows(known, lambda x: np.eye(len(v))[squared_distances(x, v).argmin(1)], "u").withColumn("label", label.cast("int")).drop("leaf_label")
            return out.withColumn("u", F.transform(F.sequence(F.lit(0), F.lit(self.k - 1)), lambda j: F.when(j == F.col("label"), 1.0).otherwise(0.0)))
        return with_rows(rows, self.degrees, "u").withColumn("label", argmax_label(F.col("u")))


def memberships(d2: np.ndarray, m: float) -> np.ndarray:
    """Fuzzy c-means degrees; a row on one or more centres is split equally among them."""
    u = np.maximum(d2, NEAR) ** (-1.0 / (m - 1.0))
    at = d2 <= NEAR
    on = at.any(1)
    u[on] = at[on]
    return u / u.sum(1, keepdims=True)


def typicalities(d2: np.ndarray, gamma: np.ndarray, eta: float, b: float) -> np.ndarray:
    return np.clip(1.0 / (1.0 + (b * d2 / np.maximum(gamma, NEAR)) ** (1.0 / (eta - 1.0))), 0.0, 1.0)


def mahalanobis(x: np.ndarray, centers: np.ndarray, norms: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(centers)))
    for j, (v, a) in enumerate(zip(centers, norms)):
        diff = x - v
        out[:, j] = np.maximum(((diff @ a) * diff).sum(1), 0.0)
    return out


def _check(k: int, m: float) -> None:
    if k < 2 or m <= 1:
        raise ValueError("fuzzy clustering needs k >= 2 and m > 1")


def _starts(rows: DataFrame, k: int, seed: int, init: str, centers: np.ndarray | None) -> np.ndarray:
    from . import many

    if centers is not None:
        return np.array(centers, float)
    return (many.plus_plus_starts if init == "kmeans++" else many.random_starts)(rows, [(k, seed)])[0]


def fcm(rows: DataFrame, k: int, m: float = 2.0, max_iter: int = 300, tol: float = 1e-5, seed: int = 1, init: str = "random", centers: np.ndarray | None = None) -> Clusters:
    """Fuzzy c-means; stops when the objective moves by less than ``tol``."""
    from . import many

    _check(k, m)
    return many.fcm_runs(rows, [_starts(rows, k, seed, init, centers)], m, max_iter, tol, [seed])[0]


def pfcm(rows: DataFrame, k: int, m: float = 2.0, eta: float = 2.0, a: float = 1.0, b: float = 1.0, scale: float = 1.0, max_iter: int = 300, tol: float = 1e-5, seed: int = 1, centers: np.ndarray | None = None) -> Clusters:
    """Possibilistic fuzzy c-means from a fuzzy one, or from given centres; ``extras['gamma']`` are the typicality widths."""
    return pfcm_runs(rows, k, [seed], m, eta, a, b, scale, max_iter, tol, None if centers is None else [centers])[0]


def _fuzzy_starts(rows: DataFrame, k: int, seeds: Sequence[int], m: float, max_iter: int, tol: float) -> list[np.ndarray]:
    """Centres of a fuzzy c-means run for each seed, all in the same scans."""
    from . import many

    return [r.centers for r in many.fcm_runs(rows, many.random_starts(rows, [(k, s) for s in seeds]), m, max(50, max_iter // 4), tol, list(seeds))]


def pfcm_runs(rows: DataFrame, k: int, seeds: Sequence[int], m: float = 2.0, eta: float = 2.0, a: float = 1.0, b: float = 1.0, scale: float = 1.0, max_iter: int = 300, tol: float = 1e-5, centers: Sequence[np.ndarray] | None = None) -> list[Clusters]:
    """``pfcm`` for every seed; a step of all runs is one scan."""
    _check(k, m)
    now = {i: np.array(c, float) for i, c in enumerate(centers if centers is not None else _fuzzy_starts(rows, k, seeds, m, max_iter, tol))}
    rows, d = packed(rows), now[0].shape[1]

    def widths(x: np.ndarray) -> np.ndarray:
        out = []
        for v in now.values():
            d2 = squared_distances(x, v)
            w = memberships(d2, m) ** m
            out += [(w * d2).sum(0), w.sum(0)]
        return np.concatenate(out)

    t = totals(rows, widths, 2 * k * len(now)).reshape(len(now), 2, k)
    gamma = np.maximum(scale * t[:, 0] / np.maximum(t[:, 1], NEAR), NEAR)
    last, done, steps, live = dict.fromkeys(now, float("inf")), dict.fromkeys(now, False), dict.fromkeys(now, 0), dict(now)
    for step in range(1, max_iter + 1):
        if not live:
            break

        def kernel(x: np.ndarray, live: dict = dict(live)) -> np.ndarray:
            out = []
            for i, v in live.items():
                d2 = squared_distances(x, v)
                ty = typicalities(d2, gamma[i], eta, b)
                w = a * memberships(d2, m) ** m + b * ty**eta
                out += [[(w * d2).sum() + (gamma[i] * (1 - ty) ** eta).sum()], w.sum(0), (w.T @ x).ravel()]
            return np.concatenate(out)

        size = 1 + k + k * d
        for i, t in zip(list(live), totals(rows, kernel, size * len(live)).reshape(len(live), size)):
            new = t[1 + k :].reshape(k, d) / np.maximum(t[1 : 1 + k], NEAR)[:, None]
            moved, now[i], steps[i] = np.abs(new - now[i]).max(), new, step
            done[i] = bool(moved < tol or abs(last[i] - t[0]) < tol * max(abs(last[i]), 1.0) and np.isfinite(last[i]))
            last[i], live[i] = float(t[0]), new
            if done[i]:
                del live[i]
    return [Clusters("pfcm", v, last[i], steps[i], done[i], s, m, {"gamma": gamma[i], "eta": eta, "b": b}) for (i, v), s in zip(now.items(), seeds)]


def typicality_frame(model: Clusters, rows: DataFrame) -> DataFrame:
    gamma, eta, b, v = model.extras["gamma"], model.extras["eta"], model.extras["b"], model.centers
    return with_rows(rows, lambda x: typicalities(squared_distances(x, v), gamma, eta, b), "t")


def fuzzy_covariances(rows: DataFrame, model: Clusters) -> np.ndarray:
    """Covariance of each cluster around its centre, weighted by u^m, in one scan."""
    v, m = model.centers, model.m
    k, d = v.shape

    def kernel(x: np.ndarray) -> np.ndarray:
        w = model.degrees(x) ** m
        return np.concatenate([w.sum(0), np.stack([((x - c).T * w[:, j]) @ (x - c) for j, c in enumerate(v)]).ravel()])

    t = totals(rows, kernel, k + k * d * d)
    return t[k:].reshape(k, d, d) / np.maximum(t[:k], NEAR)[:, None, None]


#: Part of the mean variance that is added to the diagonal of a Gustafson-Kessel covariance (a fixed value).
GK_RIDGE = 1e-4


def gustafson_kessel(rows: DataFrame, k: int, m: float = 2.0, max_iter: int = 300, tol: float = 1e-5, seed: int = 1, ridge: float = GK_RIDGE, centers: np.ndarray | None = None) -> Clusters:
    """Fuzzy clustering with a norm of its own, of volume one, for every cluster; from fuzzy c-means or given centres.

    A step takes new centres and covariances from the degrees before it.  It
    stops when no degree of any row changes by ``tol``, or the objective by
    less; degrees are not stored, a pass computes those under old and new norms
    side by side and keeps the largest change.
    """
    return gk_runs(rows, k, [seed], m, max_iter, tol, ridge, None if centers is None else [centers])[0]


def gk_runs(rows: DataFrame, k: int, seeds: Sequence[int], m: float = 2.0, max_iter: int = 300, tol: float = 1e-5, ridge: float = GK_RIDGE, centers: Sequence[np.ndarray] | None = None) -> list[Clusters]:
    """``gustafson_kessel`` for every seed.  One scan serves all runs: it ends their last step and begins the next.

    Covariances are summed around the centres before the step and then moved to the new ones.
    """
    _check(k, m)
    starts = [np.array(c, float) for c in centers] if centers is not None else _fuzzy_starts(rows, k, seeds, m, max_iter, tol)
    rows, d = packed(rows), starts[0].shape[1]
    now = {i: (v, np.stack([np.eye(d)] * k)) for i, v in enumerate(starts)}
    before, cov, last = dict.fromkeys(now), dict.fromkeys(now, np.stack([np.eye(d)] * k)), dict.fromkeys(now, float("inf"))
    done, steps, live, size = dict.fromkeys(now, False), dict.fromkeys(now, 0), list(now), 1 + k + k * d + k * d * d
    for step in range(max_iter + 1):
        if not live:
            break
        held = {i: (now[i], before[i]) for i in live}

        def kernel(x: np.ndarray, held: dict = held) -> np.ndarray:
            change, out = [], []
            for (v, norms), old in held.values():
                d2 = mahalanobis(x, v, norms)
                u = memberships(d2, m)
                change.append(np.abs(u - memberships(mahalanobis(x, *old), m)).max() if old else np.inf)
                w = u**m
                away = [x - c for c in v]
                out += [[(w * d2).sum()], w.sum(0)]
                out += [w[:, j] @ y for j, y in enumerate(away)] + [((y.T * w[:, j]) @ y).ravel() for j, y in enumerate(away)]
            return np.concatenate([change, *out])

        t = totals(rows, kernel, len(live) * (1 + size), largest=len(live))
        for i, change, part in zip(list(live), t[: len(live)], t[len(live) :].reshape(len(live), size)):
            if step:
                steps[i], done[i] = step, bool(change < tol or abs(last[i] - part[0]) < tol)
                last[i] = float(part[0])
                if done[i] or step == max_iter:
                    live.remove(i)
                    continue
            v, mass = now[i][0], part[1 : 1 + k]
            first, second = part[1 + k : 1 + k + k * d].reshape(k, d), part[1 + k + k * d :].reshape(k, d, d)
            weight = np.maximum(mass, NEAR)
            new = (first + mass[:, None] * v) / weight[:, None]
            move = new - v
            cross = first[:, :, None] * move[:, None, :]
            c = (second - cross - cross.transpose(0, 2, 1) + mass[:, None, None] * move[:, :, None] * move[:, None, :]) / weight[:, None, None]
            c = c + (ridge * np.trace(c, axis1=1, axis2=2) / d)[:, None, None] * np.eye(d) + NEAR * np.eye(d)
            cov[i], before[i] = c, now[i]
            now[i] = new, np.stack([max(np.linalg.det(x), NEAR) ** (1 / d) * np.linalg.pinv(x) for x in c])
    return [Clusters("gk", v, last[i], steps[i], done[i], s, m, {"norms": norms, "covariances": cov[i]}) for (i, (v, norms)), s in zip(now.items(), seeds)]


def lloyd(rows: DataFrame, centers: np.ndarray, max_iter: int = 300, tol: float = 1e-4, seed: int | None = None) -> Clusters:
    """k-means from given centres; an empty cluster keeps its centre."""
    from . import many

    return many.lloyd_runs(rows, [centers], max_iter, tol, [seed])[0]


def kmeans(rows: DataFrame, k: int, seed: int = 1, n_init: int = 10, max_iter: int = 300) -> Clusters:
    """k-means from several k-means++ starts, all in the same scans; the one of least cost."""
    return kmeans_runs(rows, k, [seed], n_init, max_iter)[0]


def kmeans_runs(rows: DataFrame, k: int, seeds: Sequence[int], n_init: int = 10, max_iter: int = 300) -> list[Clusters]:
    """``kmeans`` for every seed; a start that several of them have is run once, all in the same scans."""
    from . import many

    every = sorted({s + i for s in seeds for i in range(n_init)})
    found = dict(zip(every, many.lloyd_runs(rows, many.plus_plus_starts(rows, [(k, s) for s in every]), max_iter, seeds=every)))
    return [many.best_of([found[s + i] for i in range(n_init)]) for s in seeds]


def ward_cuts(rows: DataFrame, ks: Sequence[int], **options) -> dict[int, Clusters]:
    """Ward's clusters for every k, all cut from one tree; see ``ward.ward_tree``."""
    from .ward import ward_tree

    tree = ward_tree(rows, **options)
    leaves, centers, within = tree.cut(ks)
    return {k: Clusters("ahc", v, within[k], tree.rounds, True, extras={"merges": tree.merges, "leaves": leaves.select("x", F.col(f"k{k}").alias("leaf_label"))}) for k, v in centers.items()}


def ward(rows: DataFrame, k: int, seed: int = 1, **options) -> Clusters:
    """Ward's agglomeration of all rows; nothing in it is random."""
    return ward_cuts(rows, [k], **options)[k]


METHODS = {"fcm": fcm, "pfcm": pfcm, "gk": gustafson_kessel, "kmeans": kmeans, "ahc": ward}
#: Methods whose runs share their scans.
_SHARED = {"pfcm": pfcm_runs, "gk": gk_runs, "kmeans": kmeans_runs}


def run_method(method: str, rows: DataFrame, k: int, seed: int = 1, **options) -> Clusters:
    if method not in METHODS:
        raise ValueError(f"unknown clustering method {method!r}")
    return METHODS[method](rows, k, seed=seed, **options)


def with_restarts(method: str, rows: DataFrame, k: int, seeds: Sequence[int], **options) -> tuple[Clusters, list[Clusters]]:
    """The run of least objective, and all runs; agglomeration has no seed and runs once.

    Each step of all runs of a method is one scan.
    """
    from . import many

    if method == "fcm":
        _check(k, options.get("m", 2.0))
        options = dict(options)
        starts = {"kmeans++": many.plus_plus_starts}.get(options.pop("init", "random"), many.random_starts)(rows, [(k, s) for s in seeds])
        runs = many.fcm_runs(rows, starts, seeds=list(seeds), **options)
    elif method in _SHARED and not {"centers", "init"} & options.keys():
        runs = _SHARED[method](rows, k, list(seeds), **options)
    else:
        runs = [run_method(method, rows, k, seed=s, **options) for s in (list(seeds)[:1] if method == "ahc" else seeds)]
    return many.best_of(runs), runs
