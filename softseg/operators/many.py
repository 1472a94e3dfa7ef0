"""Many runs of a clustering at once: restarts and numbers of clusters share every scan.

The centres of all runs stand side by side; one pass over the rows moves them
all by a step, and runs that are done leave the pass.  So thirty restarts of
three hundred steps read the rows at most three hundred times, and a sweep over
k reads them no more often than its slowest run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import NEAR, Clusters, _check
from .vectors import packed, squared_distances, totals, width, with_rows

#: Steps from which on packing the rows pays.
FEW_STEPS = 10
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def uniform(h: np.ndarray, seed: int, place: int) -> np.ndarray:
    """Numbers in (0, 1] that follow from a row's hash, a seed and a place."""
    mask = (1 << 64) - 1
    with np.errstate(over="ignore"):
        z = h + np.uint64(((seed + 1) * _MIX[0] + (place + 1) * _MIX[1]) & mask)
        for shift, factor in ((30, _MIX[1]), (27, _MIX[2])):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(24)).astype(float) + 1.0) / float(1 << 40)


def _hashed(rows: DataFrame) -> DataFrame:
    """(x, hi, lo): halves of a hash of the vector, each exact as a double."""
    h = F.xxhash64("x")
    return rows.select("x", F.shiftrightunsigned(h, 32).cast("double").alias("hi"), h.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double").alias("lo"))


def _joined(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return (hi.astype(np.uint64) << np.uint64(32)) | lo.astype(np.uint64)


def random_starts(rows: DataFrame, runs: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """Centres of random degrees with exponent 2 for each (k, seed), in one scan; a row's degrees follow from its values and the seed alone."""
    d, ks = width(rows), [k for k, _ in runs]

    def kernel(block: np.ndarray) -> np.ndarray:
        x, h = block[:, :d], _joined(block[:, d], block[:, d + 1])
        out = []
        for k, seed in runs:
            r = np.stack([uniform(h, seed, j) for j in range(k)], 1)
            w = (r / r.sum(1, keepdims=True)) ** 2
            out += [w.sum(0), (w.T @ x).ravel()]
        return np.concatenate(out)

    t, at, centers = totals(_hashed(rows), kernel, sum(ks) * (d + 1), ("hi", "lo")), 0, []
    for k in ks:
        centers.append(t[at + k : at + k + k * d].reshape(k, d) / np.maximum(t[at : at + k], NEAR)[:, None])
        at += k + k * d
    return centers


def plus_plus_starts(rows: DataFrame, runs: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """k-means++ centres for each (k, seed): each drawn with chances as the squared distance to those before, in one scan for all runs.

    The draw is the smallest of exponential variates with these rates, from a
    hash of the row, so it is one aggregation and independent of partitions.
    """
    d, hashed = width(rows), _hashed(rows)
    seeds = sorted({seed for _, seed in runs})
    centers: dict[int, list[np.ndarray]] = {s: [] for s in seeds}
    # Runs of one seed share their first centres, whatever their k.
    for j in range(max((k for k, _ in runs), default=0)):
        held = {s: np.array(c) for s, c in centers.items()}

        def costs(block: np.ndarray, j: int = j, held: dict = held) -> np.ndarray:
            x, h = block[:, :d], _joined(block[:, d], block[:, d + 1])
            out = np.empty((len(block), len(seeds)))
            for i, s in enumerate(seeds):
                near = squared_distances(x, held[s]).min(1) if j else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    out[:, i] = np.where(near > 0, -np.log(uniform(h, s, j)) / near, np.inf)
            return out

        drawn = with_rows(hashed.select(F.concat("x", F.array("hi", "lo")).alias("x")), costs, "cost")
        row = drawn.agg(*[F.min_by("x", F.struct(F.get("cost", F.lit(i)), "x")).alias(f"s{i}") for i in range(len(seeds))]).first()
        for i, s in enumerate(seeds):
            centers[s].append(np.array(row[i][:d], float))
    return [np.array(centers[s][:k]) for k, s in runs]


class _Runs:
    """Runs that still move, their centres side by side."""

    def __init__(self, starts: Mapping[int, np.ndarray]):
        self.names = list(starts)
        self.ks = np.array([len(starts[i]) for i in self.names])
        self.at = np.concatenate([[0], np.cumsum(self.ks)[:-1]])
        self.centers = np.concatenate([starts[i] for i in self.names])
        self.n, self.d = self.centers.shape

    def degrees(self, d2: np.ndarray, m: float) -> np.ndarray:
        """Fuzzy degrees of every run; a row on centres of a run is split among them."""
        u = np.maximum(d2, NEAR) ** (-1.0 / (m - 1.0))
        on = d2 <= NEAR
        if on.any():
            hit = np.repeat(np.logical_or.reduceat(on, self.at, axis=1), self.ks, axis=1)
            u = np.where(hit, on, u)
        return u / np.repeat(np.add.reduceat(u, self.at, axis=1), self.ks, axis=1)

    def nearest(self, d2: np.ndarray) -> np.ndarray:
        """One-hot nearest centre of every run, the first of equals."""
        out = np.zeros_like(d2)
        for at, k in zip(self.at, self.ks):
            out[np.arange(len(d2)), at + d2[:, at : at + k].argmin(1)] = 1.0
        return out

    def split(self, t: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        """run -> (objective, weights, weighted sums) of the totals of a step."""
        r, out = len(self.names), {}
        for i, (name, at, k) in enumerate(zip(self.names, self.at, self.ks)):
            sums = t[r + self.n :].reshape(self.n, self.d)[at : at + k]
            out[name] = (float(t[i]), t[r + at : r + at + k], sums)
        return out


def fcm_runs(rows: DataFrame, starts: Sequence[np.ndarray], m: float = 2.0, max_iter: int = 300, tol: float = 1e-5, seeds: Sequence[int] | None = None) -> list[Clusters]:
    """Fuzzy c-means from every start, each until its objective moves by less than ``tol``; a step of all runs is one scan."""
    for v in starts:
        _check(len(v), m)
    now = {i: np.array(v, float) for i, v in enumerate(starts)}
    history: dict[int, list[float]] = {i: [] for i in now}
    live = dict(now)
    rows = packed(rows) if live and max_iter > FEW_STEPS else rows
    for step in range(1, max_iter + 1):
        if not live:
            break
        held = _Runs(live)

        def kernel(x: np.ndarray, held: _Runs = held) -> np.ndarray:
            d2 = squared_distances(x, held.centers)
            w = held.degrees(d2, m) ** m
            return np.concatenate([np.add.reduceat((w * d2).sum(0), held.at), w.sum(0), (w.T @ x).ravel()])

        for i, (cost, weight, sums) in held.split(totals(rows, kernel, len(held.names) + held.n * (held.d + 1))).items():
            history[i].append(cost)
            if step > 1 and abs(history[i][-2] - cost) < tol:
                del live[i]
            else:
                now[i] = live[i] = sums / np.maximum(weight, NEAR)[:, None]
    out = []
    for i, v in now.items():
        h = history[i]
        out.append(Clusters("fcm", v, h[-1] if h else float("inf"), len(h), len(h) > 1 and abs(h[-2] - h[-1]) < tol, seeds[i] if seeds else None, m, {"history": h}))
    return out


def lloyd_runs(rows: DataFrame, starts: Sequence[np.ndarray], max_iter: int = 300, tol: float = 1e-4, seeds: Sequence[int] | None = None) -> list[Clusters]:
    """k-means from every start; an empty cluster keeps its centre.  A step of all runs is one scan."""
    now = {i: np.array(v, float) for i, v in enumerate(starts)}
    cost, steps, done = dict.fromkeys(now, float("inf")), dict.fromkeys(now, 0), dict.fromkeys(now, False)
    live = dict(now)
    rows = packed(rows) if live and max_iter > FEW_STEPS else rows
    for step in range(1, max_iter + 1):
        if not live:
            break
        held = _Runs(live)

        def kernel(x: np.ndarray, held: _Runs = held) -> np.ndarray:
            d2 = squared_distances(x, held.centers)
            w = held.nearest(d2)
            return np.concatenate([np.add.reduceat((w * d2).sum(0), held.at), w.sum(0), (w.T @ x).ravel()])

        for i, (c, n, sums) in held.split(totals(rows, kernel, len(held.names) + held.n * (held.d + 1))).items():
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], now[i])
            cost[i], steps[i], moved, now[i] = c, step, ((new - now[i]) ** 2).sum(), new
            done[i] = moved <= tol
            live[i] = new
            if done[i]:
                del live[i]
    return [Clusters("kmeans", v, cost[i], steps[i], done[i], seeds[i] if seeds else None) for i, v in now.items()]


def best_of(runs: Sequence[Clusters]) -> Clusters:
    """The run of least objective, the first of equals."""
    return min(runs, key=lambda r: r.objective if np.isfinite(r.objective) else float("inf"))


def validity_table(rows: DataFrame, models: Sequence[Clusters], m: float = 2.0) -> list[dict]:
    """Validity of every model's fuzzy degrees and labels, in two scans for all of them.

    Partition coefficient, classification entropy (nats, and as a part of its
    maximum), Xie-Beni, objective, and of the first largest degrees as labels
    Davies-Bouldin and Calinski-Harabasz, which are NaN below two labels.
    """
    held = _Runs({i: np.asarray(v.centers, float) for i, v in enumerate(models)})
    r, c, d = len(models), held.n, held.d

    def first(x: np.ndarray) -> np.ndarray:
        d2 = squared_distances(x, held.centers)
        u = held.degrees(d2, m)
        label = held.nearest(-u)
        by_run = lambda a: np.add.reduceat(a.sum(0), held.at)
        parts = [by_run(u * u), by_run(-u * np.log(np.clip(u, 1e-12, 1.0))), by_run(u**m * d2), [len(x), (x * x).sum()], label.sum(0), (label.T @ x).ravel()]
        return np.concatenate([np.ravel(p) for p in parts])

    t = totals(rows, first, 3 * r + 2 + c + c * d)
    pc, ce, inner = t[:r], t[r : 2 * r], t[2 * r : 3 * r]
    n, square = t[3 * r], t[3 * r + 1]
    sizes, sums = t[3 * r + 2 : 3 * r + 2 + c], t[3 * r + 2 + c :].reshape(c, d)
    means = sums / np.maximum(sizes, 1)[:, None]

    def second(x: np.ndarray) -> np.ndarray:
        label = held.nearest(-held.degrees(squared_distances(x, held.centers), m))
        return (label * np.sqrt(squared_distances(x, means))).sum(0)

    scatter = totals(rows, second, c) / np.maximum(sizes, 1)
    whole = sums[: held.ks[0]].sum(0) / n
    out = []
    for i, (at, k) in enumerate(zip(held.at, held.ks)):
        v, own = held.centers[at : at + k], np.arange(at, at + k)
        own = own[sizes[own] > 0]
        apart = squared_distances(v, v)[~np.eye(k, dtype=bool)]
        within = square - (sizes[own] * (means[own] ** 2).sum(1)).sum()
        between = (sizes[own] * ((means[own] - whole) ** 2).sum(1)).sum()
        gaps = np.sqrt(squared_distances(means[own], means[own])) + np.where(np.eye(len(own), dtype=bool), np.inf, 0)
        worst = ((scatter[own][:, None] + scatter[own][None, :]) / np.maximum(gaps, 1e-300)).max(1) if len(own) > 1 else np.array([np.nan])
        out.append({
            "k": int(k), "objective": float(inner[i]), "partition_coefficient": float(pc[i] / n), "classification_entropy": float(ce[i] / n),
            "normalised_entropy": float(ce[i] / n / np.log(k)) if k > 1 else 0.0, "xie_beni": float(inner[i] / (n * max(apart.min(initial=np.inf), 1e-12))) if k > 1 else float("nan"),
            "davies_bouldin": float(worst.mean()) if len(own) > 1 else float("nan"),
            "calinski_harabasz": (float(between / (len(own) - 1) / (within / (n - len(own)))) if within > 0 else 1.0) if len(own) > 1 and n > len(own) else float("nan"),
        })
    return out
