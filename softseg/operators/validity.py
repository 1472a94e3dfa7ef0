"""Validity, stability and choice of the number of clusters.

Frames have ``id``, ``x`` array<double>, ``u`` array<double> and ``label`` int.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softseg.sources.store import materialise, side_by_side

from . import many
from .blocks import distance_totals
from .clustering import Clusters
from .vectors import dot, literal, totals, width, with_rows


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def partition_coefficient(frame: DataFrame) -> DataFrame:
    return frame.agg(F.avg(array_sum(F.transform("u", lambda x: x * x))).alias("partition_coefficient"))


def classification_entropy(frame: DataFrame) -> DataFrame:
    """Entropy in nats, and as a part of its maximum (0 for one cluster)."""
    h = array_sum(F.transform("u", lambda x: -x * F.log(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), x)))))
    one = frame.agg(F.avg(h).alias("classification_entropy"), F.max(F.size("u")).alias("k"))
    return one.select("classification_entropy", F.when(F.col("k") > 1, F.col("classification_entropy") / F.log(F.col("k").cast("double"))).otherwise(0.0).alias("normalised_entropy"))


def distance_sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def xie_beni(frame: DataFrame, centers: np.ndarray, m: float = 2.0) -> DataFrame:
    sep = min((((a - b) ** 2).sum() for a, b in combinations(np.asarray(centers), 2)), default=0.0)
    inner = sum((F.pow(F.get("u", F.lit(j)), F.lit(float(m))) * distance_sq(F.col("x"), literal(c)) for j, c in enumerate(centers)), F.lit(0.0))
    return frame.agg((F.sum(inner) / (F.count(F.lit(1)) * F.lit(max(float(sep), 1e-12)))).alias("xie_beni"))


def _centroids(frame: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """Mean vector and size of each label; labels are few."""
    parts = frame.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    got = parts.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("c")).collect()
    return {r["label"]: np.array(r["c"]) for r in got}, {r["label"]: r["n"] for r in got}


def _by_label(centroids: Mapping[int, np.ndarray], value: Callable[[np.ndarray], Column]) -> Column:
    out = None
    for label, c in centroids.items():
        out = F.when(F.col("label") == label, value(c)) if out is None else out.when(F.col("label") == label, value(c))
    return out


def davies_bouldin(frame: DataFrame) -> float:
    """Mean over clusters of the worst ratio of scatter to separation; NaN below two clusters."""
    c, _ = _centroids(frame)
    if len(c) < 2:
        return float("nan")
    spread = _by_label(c, lambda v: F.sqrt(distance_sq(F.col("x"), literal(v))))
    s = {r[0]: r[1] for r in frame.groupBy("label").agg(F.avg(spread)).collect()}
    worst = [max((s[i] + s[j]) / max(np.sqrt(((c[i] - c[j]) ** 2).sum()), 1e-300) for j in c if j != i) for i in c]
    return float(np.mean(worst))


def calinski_harabasz(frame: DataFrame) -> float:
    c, n = _centroids(frame)
    k, rows = len(c), sum(n.values())
    if k < 2 or rows <= k:
        return float("nan")
    mean = sum(c[j] * n[j] for j in c) / rows
    between = sum(n[j] * ((c[j] - mean) ** 2).sum() for j in c)
    within = frame.agg(F.sum(_by_label(c, lambda v: distance_sq(F.col("x"), literal(v))))).first()[0]
    return float(between / (k - 1) / (within / (rows - k))) if within > 0 else 1.0


def sample(frame: DataFrame, most: int, seed: int = 1) -> DataFrame:
    """Up to ``most`` rows, by a hash of the id: the same rows in any partitioning."""
    return frame.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)


def silhouette_rows(frame: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(id, label, u, s): Euclidean silhouettes of the rows of ``asked``, by default of all, among all rows of ``frame``.

    The queries meet all rows in blocks; their distances are summed by label.
    Labels are few.  A row that is alone with its label has 0, and so have all
    if there is one label only.  Null labels are left out.
    """
    frame = frame.filter("label is not null")
    sizes = {r["label"]: r["n"] for r in frame.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(sizes)
    asked = frame if asked is None else asked.filter("label is not null")
    u = F.col("u") if "u" in asked.columns else F.array(F.lit(1.0)).alias("u")
    asked = materialise(asked.select("id", F.col("label").cast("int").alias("label"), u, "x", F.monotonically_increasing_id().alias("nth")), "silhouette-queries")
    weights = F.array(*[(F.col("label") == l).cast("double") for l in labels]) if labels else F.array(F.lit(0.0))
    sums = distance_totals(asked, frame.select("x", weights.alias("w")), len(labels))
    if sums is None:
        return asked.select("id", "label", "u", F.lit(0.0).alias("s"))
    own = lambda value: F.coalesce(*[F.when(F.col("label") == l, value(j, l)) for j, l in enumerate(labels)])
    a = own(lambda j, l: F.col(f"t{j}") / max(sizes[l] - 1, 1))
    b = F.array_min(F.array(*[F.when(F.col("label") != l, F.col(f"t{j}") / sizes[l]) for j, l in enumerate(labels)]))
    alone = own(lambda j, l: F.lit(sizes[l] <= 1))
    s = F.when(alone, 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return asked.join(sums, "nth").select("id", "label", "u", s.alias("s"))


def model_silhouettes(rows: DataFrame, models: Sequence[Clusters], asked: DataFrame | None = None) -> list[float]:
    """``crisp_silhouette`` of the labels that each model gives; every distance is computed once for all models.  NaN for one label."""
    ks = [m.k for m in models]
    ends = np.cumsum([0, *ks])
    # The first largest degree, as ``assign`` labels rows.
    labels = lambda x: np.stack([m.degrees(x).argmax(1) for m in models], 1)
    marked = lambda x: (labels(x)[:, :, None] == np.arange(max(ks))).reshape(len(x), -1)[:, [i * max(ks) + j for i, k in enumerate(ks) for j in range(k)]]
    rows = rows.select("x")
    sizes = totals(rows, lambda x: marked(x).sum(0), int(ends[-1]))
    asked = materialise((rows if asked is None else asked).select("x", F.monotonically_increasing_id().alias("nth")), "silhouette-queries")
    sums = distance_totals(asked, with_rows(rows, marked, "w"), int(ends[-1]))
    if sums is None:
        return [float("nan")] * len(models)
    met = with_rows(asked, labels, "own").join(sums, "nth").select(F.concat("own", *[F.array(f"t{j}") for j in range(ends[-1])]).alias("x"))

    def widths(block: np.ndarray) -> np.ndarray:
        out, at = [len(block)], np.arange(len(block))
        for i in range(len(models)):
            own, n = block[:, i].astype(int), sizes[ends[i] : ends[i + 1]]
            t = block[:, len(models) + ends[i] : len(models) + ends[i + 1]]
            a = t[at, own] / np.maximum(n[own] - 1, 1)
            others = np.where(n > 0, t / np.maximum(n, 1), np.inf)
            others[at, own] = np.inf
            b = others.min(1)
            larger = np.maximum(a, b)
            out.append(np.where((n[own] > 1) & (larger > 0) & np.isfinite(b), (b - a) / np.where((larger > 0) & np.isfinite(b), larger, 1.0), 0.0).sum())
        return np.array(out)

    t = totals(met, widths, 1 + len(models))
    several = [(sizes[ends[i] : ends[i + 1]] > 0).sum() > 1 for i in range(len(models))]
    return [float(v / t[0]) if ok else float("nan") for v, ok in zip(t[1:], several)]


def crisp_silhouette(frame: DataFrame, asked: DataFrame | None = None) -> float:
    if frame.select("label").distinct().limit(2).count() < 2:
        return float("nan")
    return float(silhouette_rows(frame, asked).agg(F.avg("s")).first()[0])


def fuzzy_silhouette(frame: DataFrame, alpha: float = 1.0, asked: DataFrame | None = None) -> float:
    """Silhouettes weighted by how far the largest degree exceeds the second."""
    if frame.select("label").distinct().limit(2).count() < 2:
        return float("nan")
    top = F.sort_array("u", asc=False)
    w = F.pow(F.get(top, F.lit(0)) - F.coalesce(F.get(top, F.lit(1)), F.lit(0.0)), F.lit(float(alpha)))
    total, weighted, plain = silhouette_rows(frame, asked).agg(F.sum(w), F.sum(w * F.col("s")), F.avg("s")).first()
    return float(weighted / total) if total and total > 1e-12 else float(plain)


def pairwise_fuzzy_silhouette(frame: DataFrame, m: float = 2.0, asked: DataFrame | None = None) -> DataFrame:
    """(id, s) of the rows of ``asked``, by default all: silhouettes whose distances to a cluster are means over all rows, weighted by u^m.

    ``asked`` and ``frame`` have ``id``, ``x`` and ``u``.  A row belongs to its
    first largest degree; degrees below 1e-12 count as that.  With fewer than
    two clusters, and for equal distances of zero, it is 0.
    """
    k = frame.select(F.size("u")).first()
    weights = F.transform("u", lambda v: F.pow(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), v)), F.lit(float(m))))
    queries = materialise((frame if asked is None else asked).select("id", "u", "x", F.monotonically_increasing_id().alias("nth")), "silhouette-queries")
    if k is None or k[0] < 2:
        return queries.select("id", F.lit(0.0).alias("s"))
    k, rows = k[0], frame.select("x", weights.alias("w"))
    mass = rows.agg(*[F.greatest(F.sum(F.get("w", F.lit(j))), F.lit(1e-12)).alias(f"w{j}") for j in range(k)]).first()
    sums = distance_totals(queries, rows, k)
    if sums is None:
        return queries.select("id", F.lit(0.0).alias("s"))
    means = F.array(*[F.col(f"t{j}") / F.lit(float(mass[j])) for j in range(k)])
    found = queries.join(sums, "nth").select("id", means.alias("d"), (F.array_position("u", F.array_max("u")) - 1).cast("int").alias("own"))
    a, b = F.get("d", F.col("own")), F.array_min(F.filter("d", lambda x, j: j != F.col("own")))
    return found.select("id", ((b - a) / (F.greatest(a, b) + 1e-12)).alias("s"))


def prototype_silhouette(frame: DataFrame, centers: np.ndarray) -> DataFrame:
    """(id, s) from distances to centres only: one pass without pairs."""
    d = F.array_sort(F.array(*[F.sqrt(distance_sq(F.col("x"), literal(c))) for c in centers]))
    a, b = F.get(d, F.lit(0)), F.get(d, F.lit(1))
    return frame.select("id", F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)).alias("s"))


def separation(frame: DataFrame, fuzzy: bool, **options) -> float:
    return fuzzy_silhouette(frame, **options) if fuzzy else crisp_silhouette(frame, **options)


def contingency(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labels per row; 1 if both have one class."""
    cells = contingency(pairs, a, b)
    two = lambda n: n * (n - 1) / 2.0
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(f"s{c}"))
    one = cells.agg(F.sum(two(F.col("n"))).alias("s"), two(F.sum("n")).alias("total")).join(side("a")).join(side("b"))
    chance = F.try_divide(F.col("sa") * F.col("sb"), F.col("total"))
    return one.select(F.coalesce(F.try_divide(F.col("s") - chance, (F.col("sa") + F.col("sb")) / 2 - chance), F.lit(1.0)).alias("adjusted_rand"))


def assignment(gain: np.ndarray) -> list[int]:
    """Column of each row in the matching of largest total gain (square, by shortest augmenting paths)."""
    cost = -np.asarray(gain, float)
    n = len(cost)
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], col = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while match[col]:
            used[col] = True
            slack = cost[match[col] - 1] - u[match[col]] - v[1:]
            open_ = ~used[1:]
            better = open_ & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], col
            nxt = int(np.where(open_, least[1:], np.inf).argmin()) + 1
            delta = least[nxt]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            col = nxt
        while col:
            match[col], col = match[way[col]], way[col]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def membership_agreement(ref: DataFrame, other: DataFrame) -> float:
    """1 - half the mean L1 distance of two runs' degrees by id, columns matched by their overlap."""
    both = ref.select("id", F.col("u").alias("p")).join(other.select("id", F.col("u").alias("q")), "id")
    k = width(both.select(F.col("p").alias("x")))
    if not k:
        return float("nan")
    overlap = totals(both.select(F.concat("p", "q").alias("x")), lambda x: x[:, :k].T @ x[:, k:], k * k).reshape(k, k)
    at = F.array(*[F.lit(j) for j in assignment(overlap)])
    aligned = F.transform(at, lambda j: F.get("q", j))
    return float(both.agg(F.avg(1 - array_sum(F.zip_with("p", aligned, lambda a, b: F.abs(a - b))) / 2)).first()[0])


def _agreements(rows: DataFrame, runs: Sequence[Clusters]) -> list[float]:
    """``membership_agreement`` of every pair of runs of one k, in two scans for all pairs."""
    k, pairs = runs[0].k, list(combinations(range(len(runs)), 2))
    degrees = lambda x: np.hstack([r.degrees(x) for r in runs])
    size = len(runs) * k
    overlap = totals(rows, lambda x: (lambda u: u.T @ u)(degrees(x)), size * size).reshape(size, size)
    block = lambda a, b: (slice(a * k, a * k + k), slice(b * k, b * k + k))
    match = {(a, b): np.array(assignment(overlap[block(a, b)])) + b * k for a, b in pairs}

    def away(x: np.ndarray) -> np.ndarray:
        u = degrees(x)
        return np.array([len(x), *[np.abs(u[:, a * k : a * k + k] - u[:, match[a, b]]).sum() for a, b in pairs]])

    t = totals(rows, away, 1 + len(pairs))
    return [float(1 - v / max(t[0], 1) / 2) for v in t[1:]]


def pairwise_rand(labels: DataFrame, n_runs: int) -> DataFrame:
    """(a, b, n, adjusted_rand) of every pair a < b of runs, from one table of ``labels`` arrays of int.

    A row counts for a pair if it has a label in both; ``n`` are those rows.
    The contingency tables of all pairs are one aggregation.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.get("labels", F.lit(a)).alias("p"), F.get("labels", F.lit(b)).alias("q")) for a, b in combinations(range(n_runs), 2)])
    cells = labels.select(F.explode(F.filter(pairs, lambda c: c["p"].isNotNull() & c["q"].isNotNull())).alias("c")).groupBy("c.a", "c.b", "c.p", "c.q").agg(F.count(F.lit(1)).alias("n"))
    two = lambda n: n * (n - 1) / 2.0
    side = lambda c: F.sum("n").over(Window.partitionBy("a", "b", c))
    # Of each class, its first cell counts its whole size.
    first = lambda c: F.row_number().over(Window.partitionBy("a", "b", c).orderBy("p", "q")) == 1
    sized = cells.select("a", "b", "n", *[F.when(first(c), two(side(c))).otherwise(0.0).alias(f"s{c}") for c in ("p", "q")])
    one = sized.groupBy("a", "b").agg(F.sum(two(F.col("n"))).alias("s"), F.sum("sp").alias("sp"), F.sum("sq").alias("sq"), F.sum("n").alias("n"))
    chance = F.try_divide(F.col("sp") * F.col("sq"), two(F.col("n")))
    return one.select("a", "b", "n", F.coalesce(F.try_divide(F.col("s") - chance, (F.col("sp") + F.col("sq")) / 2 - chance), F.lit(1.0)).alias("adjusted_rand"))


def label_table(rows: DataFrame, runs: Sequence[Clusters], kept: Sequence[Column] | None = None) -> DataFrame:
    """(id, labels): the label of every run, null where ``kept`` leaves a row out of it; one scan, and a join for each tree."""
    trees = [i for i, r in enumerate(runs) if "leaves" in r.extras]
    asked = [c.alias(f"_kept{i}") for i, c in enumerate(kept)] if kept else []
    wide = rows.select("id", "x", *asked)
    for i in trees:
        wide = wide.join(runs[i].extras["leaves"].select("x", F.col("leaf_label").alias(f"_leaf{i}")), "x", "left")
    found = with_rows(wide, lambda x: np.stack([r.degrees(x).argmax(1) for r in runs], 1), "u")
    label = lambda i: F.coalesce(F.col(f"_leaf{i}"), F.get("u", F.lit(i)).cast("int")) if i in trees else F.get("u", F.lit(i)).cast("int")
    return found.select("id", F.array(*[F.when(F.col(f"_kept{i}"), label(i)) if kept else label(i) for i in range(len(runs))]).alias("labels"))


def stability(rows: DataFrame, runs: Sequence[Clusters]) -> dict[str, float]:
    """Mean and least adjusted Rand index over pairs of runs, and mean agreement if they are fuzzy; four scans, however many runs."""
    if len(runs) < 2:
        return {"mean_ari": float("nan"), "min_ari": float("nan"), "agreement": float("nan")}
    mean, least = pairwise_rand(label_table(rows, runs), len(runs)).agg(F.avg("adjusted_rand"), F.min("adjusted_rand")).first()
    agree = _agreements(rows, runs) if runs[0].fuzzy and mean is not None else []
    nan = float("nan")
    return {"mean_ari": nan if mean is None else mean, "min_ari": nan if least is None else least, "agreement": float(np.mean(agree)) if agree else nan}


def subsamples(n_runs: int = 10, part: float = 0.8, seed: int = 1) -> list[Column]:
    """Which rows each subsample keeps, by hashes of the id."""
    return [F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(1_000_000)) < part * 1_000_000 for i in range(n_runs)]


def subsample_stability(rows: DataFrame, fit: Callable[[DataFrame, int], Clusters], n_runs: int = 10, part: float = 0.8, seed: int = 1, kept: Sequence[Column] | None = None) -> dict[str, float]:
    """Stability over subsamples; two runs are compared on the rows that both have."""
    kept = subsamples(n_runs, part, seed) if kept is None else kept
    runs = side_by_side([lambda c=c, i=i: fit(rows.filter(c), seed + i) for i, c in enumerate(kept)])
    if len(runs) < 2:
        return {"mean_ari": float("nan"), "min_ari": float("nan")}
    mean, least = pairwise_rand(label_table(rows, runs, kept), len(runs)).agg(F.avg("adjusted_rand"), F.min("adjusted_rand")).first()
    return {"mean_ari": float("nan") if mean is None else mean, "min_ari": float("nan") if least is None else least}


def detect_elbow(ks: Sequence[int], values: Sequence[float]) -> int | None:
    """k farthest below the chord from first to last value, both axes brought to [0, 1]; none if no point is below."""
    x, y = np.asarray(ks, float), np.asarray(values, float)
    if len(x) < 3 or not np.isfinite(y).all() or np.ptp(y) == 0:
        return None
    x, y = (x - x.min()) / np.ptp(x), (y - y.min()) / np.ptp(y)
    gap = y[0] + (y[-1] - y[0]) * (x - x[0]) / (x[-1] - x[0]) - y
    return int(ks[int(gap.argmax())]) if gap.max() > 0 else None


#: k-means starts of each k in a sweep.
KMEANS_STARTS = 10


def k_metrics(rows: DataFrame, ks: Sequence[int], n_restarts: int = 5, m: float = 2.0, seed: int = 1, max_iter: int = 300, tol: float = 1e-5, asked: DataFrame | None = None) -> list[dict]:
    """Validity of the best fuzzy c-means and k-means of each k.

    All runs of all k share their scans, and so do the indices; silhouettes
    are those of the rows of ``asked``, by default of all rows, among all rows,
    whose distances are computed once for all k.
    """
    seeds = range(seed, seed + n_restarts)
    plan = [(k, s) for k in ks for s in seeds]
    soft = many.fcm_runs(rows, many.random_starts(rows, plan), m, max_iter, tol, [s for _, s in plan])
    hard_plan = [(k, seed + i) for k in ks for i in range(KMEANS_STARTS)]
    hard = many.lloyd_runs(rows, many.plus_plus_starts(rows, hard_plan), max_iter, seeds=[s for _, s in hard_plan])
    best = [many.best_of([r for r in soft if r.k == k]) for k in ks]
    least = {k: many.best_of([r for r in hard if r.k == k]).objective for k in ks}
    out = []
    for model, row, value in zip(best, many.validity_table(rows, best, m), model_silhouettes(rows, best, asked)):
        names = ("partition_coefficient", "classification_entropy", "xie_beni", "davies_bouldin", "calinski_harabasz")
        out.append({"k": model.k, "fcm_objective": model.objective, "kmeans_inertia": least[model.k], **{n: row[n] for n in names}, "silhouette": value})
    return out


def suggest_k(metrics: Sequence[Mapping]) -> dict[str, int | None]:
    """Best k by each criterion, and the one that most of five name; ties go to Davies-Bouldin's, else to the smallest."""
    ks = [r["k"] for r in metrics]

    def best(name: str, largest: bool) -> int | None:
        ok = [r for r in metrics if np.isfinite(r[name])]
        return (max if largest else min)(ok, key=lambda r: r[name])["k"] if ok else None

    out = {n: best(n, up) for n, up in (("partition_coefficient", True), ("classification_entropy", False), ("xie_beni", False), ("davies_bouldin", False), ("calinski_harabasz", True), ("silhouette", True))}
    out["fcm_elbow"] = detect_elbow(ks, [r["fcm_objective"] for r in metrics])
    out["kmeans_elbow"] = detect_elbow(ks, [r["kmeans_inertia"] for r in metrics])
    votes = [v for n in ("davies_bouldin", "xie_beni", "fcm_elbow", "kmeans_elbow", "silhouette") if (v := out[n]) is not None]
    top = [k for k in sorted(set(votes)) if votes.count(k) == max(map(votes.count, votes))] if votes else []
    out["recommended"] = out["davies_bouldin"] if out["davies_bouldin"] in top else (top[0] if top else None)
    return out


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
