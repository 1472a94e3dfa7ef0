"""Ward's agglomeration by reciprocal nearest neighbours over a distributed neighbour table.

The table has, for every cluster, its size, mean, nearest cluster and the cost
of joining it.  A round merges all pairs that are each other's nearest, writes
the merges, and asks anew only for the clusters that are new or whose nearest
is gone: Ward's cost is reducible, so no other cluster's neighbour changes.
The asked meet all clusters in blocks.  When at most ``LOCAL`` clusters are left,
the rest of the same rounds is done on the driver.

The merges are one table, of which any number of clusters can be cut.  Exact
agglomeration looks at all pairs of rows once, and this is where it ends: the
first round costs n^2 distances, whatever the number of machines.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softseg.sources.store import materialise

from .blocks import STEP, meet, tiles

#: Clusters from which the driver goes on, at most: a few megabytes of means, whose rounds would each cost the cluster several jobs.
LOCAL = 8_192
#: Place of a round's number in the ids of its clusters.
_ROUND = 1 << 46
MAX_ROUNDS = 100_000
_ACTIVE = "c long, n double, x array<double>, h double"
_MERGES = "node long, a long, b long, height double, n double"


def _cheapest(q: np.ndarray, size: np.ndarray, own: np.ndarray):
    """(take in clusters x, sizes n and ascending ids c; ids and costs found): for each of ``q`` the cluster whose joining costs least, of equals the first."""
    cost, best = np.full(len(q), np.inf), np.full(len(q), np.iinfo(np.int64).max)
    near, by_own = tiles(q), np.argsort(own)
    ascending = own[by_own]

    def add(x: np.ndarray, n: np.ndarray, c: np.ndarray) -> None:
        place = np.minimum(np.searchsorted(ascending, c), len(own) - 1)
        mine = ascending[place] == c
        at_self = np.full(len(q), -1)
        at_self[by_own[place[mine]]] = np.flatnonzero(mine)
        alike = (n == n[0]).all()
        for at, d2 in near(x):
            s, self_ = size[at], at_self[at]
            if alike and (s == n[0]).all():
                d2 *= n[0] / 2
            else:
                d2 *= n
                d2 /= s[:, None] + n
                d2 *= s[:, None]
            d2[self_ >= 0, self_[self_ >= 0]] = np.inf
            first = d2.argmin(1)
            new = d2[np.arange(len(d2)), first]
            better = (new < cost[at]) | ((new == cost[at]) & (c[first] < best[at]))
            cost[at] = np.where(better, new, cost[at])
            best[at] = np.where(better, c[first], best[at])

    return add, lambda: [best, cost]


def _nearest(asked: DataFrame, active: DataFrame) -> DataFrame:
    """``asked`` with ``nn`` and ``cost``: the cluster whose joining costs least, of equals the first."""

    def meeting(q: np.ndarray, more: Sequence[np.ndarray]):
        take, result = _cheapest(q, more[0].astype(float), more[1].astype(np.int64))

        def add(x: np.ndarray, batch: pa.RecordBatch) -> None:
            n, c = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            order = np.argsort(c)
            take(x[order], n[order], c[order])

        return add, result

    found = meet(asked.select(F.col("c").alias("nth"), "x", "n", "c"), active, ("n", "c"), ("n", "c"), meeting, "nn long, cost double")
    least = found.groupBy("nth").agg(F.min(F.struct("cost", "nn")).alias("p"))
    return asked.join(least.select(F.col("nth").alias("c"), "p.nn", "p.cost"), "c").select("c", "n", "x", "h", "nn", "cost")


def _local(clusters: Sequence, first: int) -> list[tuple[int, int, int, float, float]]:
    """The rounds that are left, on clusters (c, n, x, h): (node, a, b, height, n) of every merge.

    They ask as the distributed rounds do, a tile of distances at a time.
    """
    ids, n, h = np.array([r["c"] for r in clusters], np.int64), np.array([r["n"] for r in clusters], float), np.array([r["h"] for r in clusters], float)
    x, merges = np.array([r["x"] for r in clusters], float), []
    nn, cost, asked = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.arange(len(ids))
    while len(ids) > 1:
        if len(asked):
            add, result = _cheapest(x[asked], n[asked], asked)
            for i in range(0, len(ids), STEP):
                add(x[i : i + STEP], n[i : i + STEP], np.arange(i, min(i + STEP, len(ids))))
            nn[asked], cost[asked] = result()
        a = np.flatnonzero((nn[nn] == np.arange(len(nn))) & (np.arange(len(nn)) < nn))
        if not len(a):  # ties alone keep pairs from being each other's nearest
            a = np.array([int(cost.argmin())])
        b = nn[a]
        height = np.maximum(np.sqrt(2 * np.minimum(cost[a], np.where(nn[b] == a, cost[b], np.inf))), np.maximum(h[a], h[b]))
        order = np.argsort(height, kind="stable")
        a, b, height = a[order], b[order], height[order]
        size = n[a] + n[b]
        nodes = first + np.arange(len(a))
        first += len(a)
        merges += list(zip(nodes.tolist(), ids[a].tolist(), ids[b].tolist(), height.tolist(), size.tolist()))
        mean = (x[a] * n[a][:, None] + x[b] * n[b][:, None]) / size[:, None]
        rest = np.setdiff1d(np.arange(len(ids)), np.concatenate([a, b]))
        moved = np.full(len(ids), -1)
        moved[rest] = np.arange(len(rest))
        nn, cost = np.concatenate([moved[nn[rest]], np.full(len(a), -1)]), np.concatenate([cost[rest], np.zeros(len(a))])
        asked = np.flatnonzero(nn < 0)
        ids, x = np.concatenate([ids[rest], nodes]), np.concatenate([x[rest], mean])
        n, h = np.concatenate([n[rest], size]), np.concatenate([h[rest], height])
    return merges


@dataclass
class Tree:
    """``leaves`` (leaf, x, n), equal rows being one, and ``merges`` (node, a, b, height, n), both written."""

    leaves: DataFrame
    merges: DataFrame
    rounds: int

    def cut(self, ks: Sequence[int]) -> tuple[DataFrame, dict[int, np.ndarray], dict[int, float]]:
        """Leaves with a label ``k2``, ``k3``, ... for each of ``ks``, the centres of each cut, and its within sums of squares.

        Labels go by size, largest first, then by centre.  A cut asks for no
        more clusters than there are leaves.
        """
        ks = sorted(set(ks))
        top = self.merges.orderBy(F.desc("height"), F.desc("node")).limit(ks[-1] - 1).collect()
        all_ = float(self.merges.agg(F.coalesce(F.sum(F.col("height") ** 2 / 2), F.lit(0.0))).first()[0])
        high = [r["node"] for r in top]
        links = self.merges.filter(~F.col("node").isin(high)).select(F.explode(F.array("a", "b")).alias("c"), F.col("node").alias("root"))
        now = materialise(links, "ward-roots")
        for _ in range(MAX_ROUNDS):
            further = now.select(F.col("c").alias("root"), F.col("root").alias("next"))
            now = materialise(now.join(further, "root", "left").select("c", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ward-roots")
            if now.filter("moved").isEmpty():
                break
        rooted = self.leaves.join(now.select(F.col("c").alias("leaf"), "root"), "leaf", "left").withColumn("root", F.coalesce("root", "leaf"))
        parts = rooted.select("root", "n", F.posexplode("x").alias("i", "v")).groupBy("root", "i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"), F.sum("n").alias("n"))
        groups = parts.groupBy("root").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x")).collect()
        held = {r["root"]: ([r["root"]], r["n"], np.array([p["v"] for p in r["x"]])) for r in groups}
        labels, centers, within, spent = {}, {}, {}, all_ - sum(r["height"] ** 2 / 2 for r in top)
        for r in [None, *reversed(top)]:
            if r is not None:
                (p, n, x), (q, w, y) = held.pop(r["a"]), held.pop(r["b"])
                held[r["node"]] = (p + q, n + w, (x * n + y * w) / (n + w))
                spent += r["height"] ** 2 / 2
            if len(held) in ks or (r is None and len(held) < ks[-1]):
                order = sorted(held.values(), key=lambda g: (-g[1], tuple(g[2])))
                for k in ks if r is None and len(held) < ks[-1] else [len(held)]:
                    if k >= len(held):
                        labels[k] = {root: j for j, g in enumerate(order) for root in g[0]}
                        centers[k], within[k] = np.stack([g[2] for g in order]), spent
        def at(k: int):
            return F.coalesce(*[F.when(F.col("root") == root, F.lit(j)) for root, j in labels[k].items()]).alias(f"k{k}")

        return rooted.select("leaf", "x", "n", *[at(k) for k in ks if k in labels]), centers, within


def _joined(pairs: DataFrame, step: int) -> DataFrame:
    """(node, a, b, height, n, x) of pairs (a, b, g), whose clusters ``g`` (n, x, h, cost) are two."""
    p, q = F.col("g")[0], F.col("g")[1]
    n = p["n"] + q["n"]
    mean = F.zip_with(p["x"], q["x"], lambda u, v: (u * p["n"] + v * q["n"]) / n)
    height = F.greatest(F.sqrt(2 * F.least(p["cost"], q["cost"])), p["h"], q["h"])
    node = F.monotonically_increasing_id() + F.lit(step * _ROUND)
    return pairs.select(node.alias("node"), "a", "b", height.alias("height"), n.alias("n"), mean.alias("x"))


def ward_tree(rows: DataFrame, local: int = LOCAL) -> Tree:
    """The whole tree over the vectors ``x`` of ``rows``; vectors that are equal are one leaf, whose weight is their number."""
    counted = rows.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n"))
    leaves = materialise(counted.select(F.monotonically_increasing_id().alias("leaf"), "x", "n"), "ward-leaves")
    spark, parts, step = rows.sparkSession, [], 0
    active = leaves.select(F.col("leaf").alias("c"), "n", "x", F.lit(0.0).alias("h"))
    count, near = active.count(), None
    while count > local and count > 1:
        step += 1
        if near is None:
            near = materialise(_nearest(active, active), "ward-near")
        pair = near.groupBy(F.least("c", "nn").alias("a"), F.greatest("c", "nn").alias("b")).agg(F.collect_list(F.struct("n", "x", "h", "cost")).alias("g"))
        mutual = pair.filter(F.size("g") == 2)
        made = materialise(_joined(mutual, step), "ward-merges")
        n_made = made.count()
        if not n_made:
            # Only ties and rounding do that: the cheapest join is made by itself.
            r = near.orderBy("cost", "c").first()
            other = near.filter(F.col("c") == r["nn"]).first()
            mutual = spark.createDataFrame([(min(r["c"], r["nn"]), max(r["c"], r["nn"]), [(p["n"], p["x"], p["h"], r["cost"]) for p in (r, other)])], "a long, b long, g array<struct<n: double, x: array<double>, h: double, cost: double>>")
            made, n_made = materialise(_joined(mutual, step), "ward-merges"), 1
        parts.append(made.select("node", "a", "b", "height", "n"))
        gone = made.select(F.explode(F.array("a", "b")).alias("c"))
        kept = near.join(gone, "c", "left_anti").join(gone.select(F.col("c").alias("nn"), F.lit(True).alias("stale")), "nn", "left")
        fresh = made.select(F.col("node").alias("c"), "n", "x", F.col("height").alias("h"))
        count -= n_made
        if count <= local:
            active = kept.select("c", "n", "x", "h").unionByName(fresh)
            break
        kept = materialise(kept, "ward-kept")
        active = kept.select("c", "n", "x", "h").unionByName(fresh)
        asked = kept.filter("stale").select("c", "n", "x", "h").unionByName(fresh)
        near = materialise(kept.filter("stale is null").select("c", "n", "x", "h", "nn", "cost").unionByName(_nearest(asked, active)), "ward-near")
    # At most ``local`` clusters, or one.
    rest = _local(active.select("c", "n", "x", "h").orderBy("c").collect(), (step + 1) * _ROUND) if count > 1 else []
    parts.append(spark.createDataFrame(rest, _MERGES))
    return Tree(leaves, materialise(functools.reduce(DataFrame.unionByName, parts), "ward-tree"), step)
