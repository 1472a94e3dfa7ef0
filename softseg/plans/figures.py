"""The data behind the figures, as frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from softseg.functions.membership import Complement, Membership, grid, hour_window
from softseg.operators import clustering
from softseg.operators.counts import membership_band
from softseg.operators.fuzzify import Fuzzifier
from softseg.operators.vectors import squared_distances, with_rows


def _stack(frames: list[DataFrame]) -> DataFrame:
    return fold(DataFrame.unionByName, frames)


def membership_curves(spark: SparkSession, engine: Fuzzifier, points: int = 401) -> DataFrame:
    """(feature, term, x, mu): on [0, 1], on the support if that is wider, or over a day."""
    out = []
    for f in engine.features:
        shapes: Mapping[str, Membership] = {"working": f.window, "non_working": Complement(f.window)} if f.window else f.terms
        hi = 24.0 if f.window else max(1.0, *(m.support()[1] for m in shapes.values())) if f.normalisation == "none" else 1.0
        out += [grid(spark, m, 0.0, hi, 481 if f.window else points).withColumns({"feature": F.lit(f.name), "term": F.lit(t)}) for t, m in shapes.items()]
    return _stack(out).select("feature", "term", "x", "mu")


def shift_curves(spark: SparkSession, windows: Mapping, points: int = 481) -> DataFrame:
    """(pattern, x, mu) over the hours of a day."""
    return _stack([grid(spark, hour_window(w), 0.0, 24.0, points).withColumn("pattern", F.lit(n)) for n, w in windows.items()]).select("pattern", "x", "mu")


def alpha_intervals(spark: SparkSession, shape: Membership, levels: Sequence[float], points: int = 2001) -> DataFrame:
    """(alpha, lo, hi) of the cuts of one set."""
    curve = grid(spark, shape, *shape.support(), points)
    levels_ = F.explode(F.array(*map(F.lit, map(float, levels)))).alias("alpha")
    return curve.select("x", "mu", levels_).filter("mu >= alpha").groupBy("alpha").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def contour_grid(points: DataFrame, centers2, m: float = 2.0, side: int = 200, padding: float = 0.1) -> DataFrame:
    """(x, u, strength, band): fuzzy degrees on a grid around the points' first two dimensions."""
    box = points.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in (0, 1) for n, f in (("lo", F.min), ("hi", F.max))])
    cells = box.select("*", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("a")).select("*", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("b"))

    def at(i: int, c: str):
        span = F.col(f"hi{i}") - F.col(f"lo{i}")
        return F.col(f"lo{i}") - span * padding + F.col(c) * span * (1 + 2 * padding) / (side - 1)

    out = with_rows(cells.select(F.array(at(0, "a"), at(1, "b")).alias("x")), lambda x: clustering.memberships(squared_distances(x, centers2), m))
    return out.withColumn("strength", F.array_max("u")).withColumn("band", membership_band(F.array_max("u")))


def scatter(frame: DataFrame, most: int = 2000, seed: int = 1) -> DataFrame:
    """(pc1, pc2, label) of a bounded sample by a hash of the id."""
    return frame.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).select(F.col("x")[0].alias("pc1"), F.col("x")[1].alias("pc2"), "label")


def heatmap(frame: DataFrame, most: int = 400) -> DataFrame:
    """(id, u, label): the first rows by label, then by largest degree."""
    return frame.orderBy("label", F.array_max("u").desc(), "id").limit(most).select("id", "u", "label")


def profile_bars(averages: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(cluster, z-score of each column across clusters)."""
    w = Window.partitionBy()
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)), F.lit(0.0))
    return averages.select("cluster", *[z(c).alias(c) for c in columns])
