"""Exact quantiles of any number of rows and columns.

Every wanted place is bracketed by an approximate quantile, the rows below and
inside all brackets are counted in one scan, and brackets that still hold many
rows are bracketed again within themselves.  When all are small, one more
aggregation reads the values at the ranks.  Each scan serves all columns and
all quantiles; what a task holds is bounded.  The result is the linear
interpolation between neighbouring ranks, as of ``percentile``, whose memory
grows with the distinct values instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a bracket from which on it is narrowed.
SMALL_ROWS = 1_000_000
#: Ranks off by at most one part in this many, in the bracketing step.
ACCURACY = 10_000
#: Aggregates of one scan, at most.
_AT_ONCE = 120


def _aggregate(frame: DataFrame, wanted: Mapping[str, Column]) -> dict:
    """All aggregates by name; some hundred at a time, so that a plan stays small."""
    names, out = list(wanted), {}
    for at in range(0, len(names), _AT_ONCE):
        row = frame.agg(*[wanted[n].alias(f"a{i}") for i, n in enumerate(names[at : at + _AT_ONCE])]).first()
        out |= dict(zip(names[at : at + _AT_ONCE], row))
    return out


def exact_quantiles(frame: DataFrame, values: Mapping[str, Column], quantiles: Sequence[float], small_rows: int = SMALL_ROWS, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Name -> quantiles of its column, nulls left out; null if there is no value.  NaN counts as the largest number."""
    if not values or not quantiles:
        return {n: [] for n in values}
    names = list(values)
    cols = frame.select(*[v.cast("double").alias(f"v{j}") for j, v in enumerate(values.values())])
    col = [F.col(f"v{j}") for j in range(len(names))]
    known = _aggregate(cols, {(j, what): f(c) for j, c in enumerate(col) for what, f in (("n", F.count), ("lo", F.min), ("hi", F.max))})
    places = [(j, i) for j in range(len(names)) for i in range(len(quantiles)) if known[j, "n"]]
    rank = {(j, i): quantiles[i] * (known[j, "n"] - 1) for j, i in places}
    box = {(j, i): (known[j, "lo"], known[j, "hi"]) for j, i in places}
    inside, below = {p: known[p[0], "n"] for p in places}, dict.fromkeys(places, 0)
    within = lambda p: col[p[0]].between(F.lit(box[p][0]), F.lit(box[p][1]))
    while large := [p for p in places if inside[p] > small_rows and box[p][0] < box[p][1]]:
        off, tried, moved = 3 / accuracy, dict(box), False
        while not moved:
            ends = {p: [max(0.0, (rank[p] - below[p]) / (inside[p] - 1) - off), min(1.0, (rank[p] - below[p]) / (inside[p] - 1) + off)] for p in large}
            near = _aggregate(cols, {p: F.percentile_approx(F.when(within(p), col[p[0]]), ends[p], accuracy) for p in large})
            for p in large:
                tried[p] = (box[p][0] if ends[p][0] <= 0 else near[p][0], box[p][1] if ends[p][1] >= 1 else near[p][1])
            counts = _aggregate(cols, {(p, w): F.count(F.when(c, 1)) for p in large for w, c in (("below", col[p[0]] < tried[p][0]), ("in", col[p[0]].between(*map(F.lit, tried[p]))))})
            # A bracket counts if it holds the ranks on both sides of its place; a wider one is tried if none does.
            for p in large:
                b, n = counts[p, "below"], counts[p, "in"]
                if b <= int(rank[p]) and (int(rank[p]) + 1 < b + n or tried[p][1] == box[p][1]) and n < inside[p]:
                    box[p], below[p], inside[p], moved = tried[p], b, n, True
            off *= 4
            if off > 1:
                break
        if not moved:
            break
    fraction = {p: min(1.0, max(0.0, (rank[p] - below[p]) / (inside[p] - 1))) if inside[p] > 1 else 0.0 for p in places}
    open_ = [p for p in places if box[p][0] < box[p][1]]
    found = {p: float(box[p][0]) for p in places} | _aggregate(cols, {p: F.percentile(F.when(within(p), col[p[0]]), F.lit(fraction[p])) for p in open_})
    return {n: [found.get((j, i)) for i in range(len(quantiles))] for j, n in enumerate(names)}
