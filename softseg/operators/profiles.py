"""Profiles of clusters: group averages, distributions, archetypes, overlap, interpretability and privacy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .compliance import MIN_GROUP
from .validity import assignment

# Indicators of a profile, and the archetypes' z-scores by indicator.
PROFILE_INDICATORS = ("posts_per_month", "comments_per_month", "reactions_per_month", "chat_events_per_month", "topic_accesses_per_month", "working_hours_share", "non_working_hours_share")
ARCHETYPE_INDICATORS = PROFILE_INDICATORS[:6]
ARCHETYPES = {
    "High Communicators": (1.5, 1.5, 1.0, 1.5, 0.3, -1.0),
    "Reactive Consumers": (-0.3, 0.0, 0.8, 0.0, -0.3, -0.2),
    "Operational Browsers": (-0.5, -0.5, -0.4, -0.4, 1.5, 1.2),
    "Low-Engagement Users": (-0.8, -0.9, -1.2, -1.0, -1.3, 0.2),
}


def by_cluster(frame: DataFrame) -> DataFrame:
    """One row per user and cluster: (..., cluster, w)."""
    return frame.select("*", F.posexplode("u").alias("cluster", "w"))


def feature_averages(frame: DataFrame, columns: Sequence[str] = PROFILE_INDICATORS, weighted: bool = False) -> DataFrame:
    """Mean of each column by label, or by cluster weighted with the degrees."""
    if not weighted:
        return frame.groupBy(F.col("label").alias("cluster")).agg(*[F.avg(c).alias(c) for c in columns])
    w = F.sum("w")
    return by_cluster(frame.select("u", *columns)).groupBy("cluster").agg(*[F.try_divide(F.sum(F.col("w") * F.col(c)), w).alias(c) for c in columns])


def membership_distribution(frame: DataFrame) -> DataFrame:
    """(cluster, size, share, mass, mass_share, mean_membership of its members)."""
    own = F.col("label") == F.col("cluster")
    rows = by_cluster(frame.select("u", "label")).groupBy("cluster").agg(
        F.count(F.when(own, 1)).alias("size"), F.sum("w").alias("mass"), F.avg(F.when(own, F.col("w"))).alias("mean_membership"), F.count(F.lit(1)).alias("n")
    )
    return rows.select("cluster", "size", (F.col("size") / F.col("n")).alias("share"), "mass", (F.col("mass") / F.col("n")).alias("mass_share"), "mean_membership")


def dominant_attributes(fuzzy: DataFrame, attributes: Sequence[str], top: int = 5) -> DataFrame:
    """(cluster, direction, nth, attribute, z, mean): attributes farthest above and below the population, by cluster.

    ``fuzzy`` has ``u`` and the attributes.  Means are weighted by degree;
    z-scores use the population's deviation (1 if there is none).
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("v")) for a in attributes])).alias("p")
    long = fuzzy.select("u", pairs).select("u", "p.attribute", "p.v")
    base = long.groupBy("attribute").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    means = long.select("attribute", "v", F.posexplode("u").alias("cluster", "w")).groupBy("cluster", "attribute").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("mean"))
    z = means.join(base, "attribute").select("cluster", "attribute", "mean", ((F.col("mean") - F.col("m")) / F.when(F.col("s") > 1e-12, F.col("s")).otherwise(1.0)).alias("z"))
    out = None
    for name, order in (("high", F.col("z").desc()), ("low", F.col("z").asc())):
        nth = F.row_number().over(Window.partitionBy("cluster").orderBy(order, "attribute"))
        part = z.select("cluster", F.lit(name).alias("direction"), nth.alias("nth"), "attribute", "z", "mean").filter(F.col("nth") <= top)
        out = part if out is None else out.unionByName(part)
    return out


def overlap_summary(frame: DataFrame, mixed: float = 0.3) -> DataFrame:
    """(mixed_share, mean_max): rows whose second degree reaches ``mixed``, and the mean largest degree."""
    second = F.coalesce(F.get(F.sort_array("u", asc=False), F.lit(1)), F.lit(0.0))
    return frame.agg(F.avg((second >= mixed).cast("double")).alias("mixed_share"), F.avg(F.array_max("u")).alias("mean_max"))


def pairwise_overlap(frame: DataFrame) -> DataFrame:
    """(a, b, overlap): mean of the smaller of two degrees."""
    pairs = frame.select(F.col("u"), F.posexplode("u").alias("a", "p")).select("a", "p", F.posexplode("u").alias("b", "q"))
    return pairs.groupBy("a", "b").agg(F.avg(F.least("p", "q")).alias("overlap"))


def label_archetypes(averages: Mapping[int, Mapping[str, float]], templates: Mapping[str, Sequence[float]] = ARCHETYPES) -> dict[int, tuple[str, float]]:
    """Cluster -> (archetype, cosine): z-scores across clusters matched one to one with the templates; the rest are numbered segments."""
    clusters, names = sorted(averages), list(templates)
    x = np.array([[averages[c].get(i, 0.0) or 0.0 for i in ARCHETYPE_INDICATORS] for c in clusters], float)
    spread = x.std(0)
    z = (x - x.mean(0)) / np.where(spread > 1e-12, spread, 1.0)
    t = np.array([templates[n] for n in names], float)
    norm = np.linalg.norm(z, axis=1)[:, None] * np.linalg.norm(t, axis=1)[None, :]
    score = (z @ t.T) / np.where(norm > 0, norm, 1.0)
    size = max(score.shape)
    square = np.full((size, size), -2.0)
    square[: score.shape[0], : score.shape[1]] = score
    found = assignment(square)
    return {c: (names[found[i]], float(score[i, found[i]])) if found[i] < len(names) else (f"Segment {c + 1}", float("nan")) for i, c in enumerate(clusters)}


def dominance_clarity(z: np.ndarray, top: int = 3) -> float:
    """Half how much of a cluster's profile its strongest features hold, half how unlike the profiles are."""
    z = np.asarray(z, float)
    k, d = z.shape
    size = np.abs(z)
    held = np.sort(size, axis=1)[:, ::-1][:, :top].sum(1) / np.maximum(size.sum(1), 1e-12)
    even = min(top, d) / d
    focus = float(np.clip((held - even) / max(1 - even, 1e-12), 0, 1).mean()) if even < 1 else 1.0
    unit = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    cos = (unit @ unit.T)[np.triu_indices(k, 1)]
    apart = float((1 - (cos.mean() if len(cos) else 1.0)) / 2)
    return 0.5 * focus + 0.5 * apart


def transparency(normalised_entropy: float, fuzzy: bool) -> float:
    return float(np.clip(1 - normalised_entropy, 0, 1)) if fuzzy else 0.0


def semantic_consistency(ratings: DataFrame | None, column: str = "rating") -> float | None:
    """Mean expert rating, from 1-5 brought to 0-1."""
    if ratings is None:
        return None
    mean, most = ratings.agg(F.avg(column), F.max(column)).first()
    if mean is None:
        return None
    return float(np.clip((mean - 1) / 4 if most > 1 else mean, 0, 1))


def interpretability(parts: Mapping[str, float | None], weights: Mapping[str, float] | None = None) -> float:
    """Weighted mean of the parts that there are."""
    have = {n: v for n, v in parts.items() if v is not None and np.isfinite(v)}
    w = {n: (weights or {}).get(n, 1.0) for n in have}
    total = sum(w.values())
    return sum(have[n] * w[n] for n in have) / total if total > 0 else float("nan")


def privacy(fuzzy_representation: bool, sizes: Sequence[int], violations: Sequence[str] = (), minimum: int = MIN_GROUP) -> str:
    return "High" if fuzzy_representation and not violations and all(s >= minimum for s in sizes) else "Low"
