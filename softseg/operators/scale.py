"""Column scalers.  Statistics come from one aggregation, values from one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

TINY = 1e-12


def _stats(frame: DataFrame, columns: Sequence[str], *measures) -> dict[str, list]:
    row = frame.agg(*[m(F.col(c).cast("double")).alias(f"{i}_{j}") for i, c in enumerate(columns) for j, m in enumerate(measures)]).first()
    return {c: [row[f"{i}_{j}"] for j in range(len(measures))] for i, c in enumerate(columns)}


def _with(frame: DataFrame, columns: Sequence[str], value) -> DataFrame:
    return frame.select(*[value(c).alias(c) if c in columns else F.col(c) for c in frame.columns])


def log1p(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _with(frame, columns, lambda c: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))))


def winsorize(frame: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values clipped to exact quantiles of their column."""
    at = exact_quantiles(frame, {c: F.col(c) for c in columns}, (low, high))
    return _with(frame, columns, lambda c: F.least(F.greatest(F.col(c).cast("double"), F.lit(at[c][0])), F.lit(at[c][1])))


def _affine(frame: DataFrame, columns: Sequence[str], at: dict[str, tuple[float, float]]) -> DataFrame:
    return _with(frame, columns, lambda c: (F.col(c).cast("double") - F.lit(at[c][0])) / F.lit(at[c][1]))


def robust_scale(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / interquartile range; a range of 0 counts as 1."""
    at = exact_quantiles(frame, {c: F.col(c) for c in columns}, (0.25, 0.5, 0.75))
    return _affine(frame, columns, {c: (q[1] or 0.0, ((q[2] or 0.0) - (q[0] or 0.0)) or 1.0) for c, q in at.items()})


def standard_scale(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    at = _stats(frame, columns, F.avg, F.stddev_pop)
    return _affine(frame, columns, {c: (m, s if s > TINY else 1.0) for c, (m, s) in at.items()})


def unit_variance(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    at = _stats(frame, columns, F.stddev_pop)
    return _affine(frame, columns, {c: (0.0, s if s > TINY else 1.0) for c, (s,) in at.items()})


def minmax_scale(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    at = _stats(frame, columns, F.min, F.max)
    return _affine(frame, columns, {c: (lo, hi - lo if hi - lo > TINY else 1.0) for c, (lo, hi) in at.items()})


SCALERS = {"none": lambda frame, columns: frame, "standard": standard_scale, "unit_var": unit_variance, "minmax": minmax_scale}


def scale(frame: DataFrame, columns: Sequence[str], method: str) -> DataFrame:
    if method not in SCALERS:
        raise ValueError(f"unknown scaler {method!r}")
    return SCALERS[method](frame, columns)


def l1_composition(frame: DataFrame, columns: Sequence[str], eps: float = 1e-12) -> DataFrame:
    """Every row's values as parts of their sum."""
    total = sum((F.col(c).cast("double") for c in columns), F.lit(0.0)) + F.lit(eps)
    return _with(frame, columns, lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), total), F.lit(0.0)))


def finite(x: Column) -> Column:
    """Null, NaN and infinities as 0."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x).otherwise(0.0)


def full_resolution(frame: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """log1p, winsorised, robust-scaled; what is not a number is 0."""
    out = robust_scale(winsorize(log1p(frame, columns), columns, low, high), columns)
    return _with(out, columns, lambda c: finite(F.col(c)))


def impute_median(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls, NaN and infinities as the median of the rest."""
    good = lambda x: F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
    at = exact_quantiles(frame, {c: good(F.col(c).cast("double")) for c in columns}, (0.5,))
    return _with(frame, columns, lambda c: F.coalesce(good(F.col(c).cast("double")), F.lit(at[c][0])))


def drop_non_finite(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    keep = None
    for c in columns:
        x = F.col(c).cast("double")
        ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
        keep = ok if keep is None else keep & ok
    return frame if keep is None else frame.filter(keep)


def preprocess_auto(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By the smallest value: from -1 down as it is, below 0 z-scores, else log1p and z-scores."""
    least = min((v[0] for v in _stats(frame, columns, F.min).values()), default=0.0)
    if least <= -1:
        return frame
    return standard_scale(frame if least < 0 else log1p(frame, columns), columns)


VARIANTS = ("raw", "log1p", "winsor", "robust", "composition")


def variant(frame: DataFrame, columns: Sequence[str], step: str) -> DataFrame:
    """The five preprocessing steps, each with those before it; the composition starts from the raw counts."""
    if step not in VARIANTS:
        raise ValueError(f"unknown variant {step!r}")
    if step == "composition":
        return robust_scale(l1_composition(frame, columns), columns)
    for name, f in (("log1p", log1p), ("winsor", winsorize), ("robust", robust_scale)):
        if VARIANTS.index(step) >= VARIANTS.index(name):
            frame = f(frame, columns)
    return frame
