"""Fuzzification: indicators to degrees in linguistic terms.

Normalisers are fitted in one aggregation over all features; the transform is
one projection of column expressions, so it adds no shuffle to its input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softseg.functions.membership import Complement, Membership, alpha_cut, check_alpha, hour_window, membership, partition
from softseg.functions.scalars import share

from .compliance import MIN_GROUP
from .ranks import with_cume_dist
from .indicators import HOURS
from .quantiles import exact_quantiles

NORMALISATIONS = ("none", "minmax", "log_minmax", "quantile")
ALPHA_LEVELS = (0.2, 0.5, 0.8)
UPPER_QUANTILE = 0.99

# Working-hour windows of shift patterns.
SHIFT_WINDOWS = {
    "office": [6, 8, 16, 18],
    "day": [6, 8, 16, 18],
    "night": [20, 22, 4, 6],
    "short": [8, 9, 13, 14],
    "long": [6, 7, 19, 20],
    "split": {"windows": [[7, 8, 11.5, 12.5], [13.5, 14.5, 18, 19]]},
}


def _terms(family: str, **params: list[float]) -> dict:
    return {term: {"family": family, "params": p} for term, p in params.items()}


# The default fuzzy variables.
DEFAULT_FEATURES = (
    {"name": "posting", "indicator": "posts_per_month", "terms": {"low": {"family": "trapezoidal", "params": [0.0, 0.0, 0.15, 0.4]}, "medium": {"family": "triangular", "params": [0.2, 0.5, 0.8]}, "high": {"family": "trapezoidal", "params": [0.55, 0.85, 1.0, 1.0]}}, "alpha_cut": {"level": 0.5, "terms": ["high"]}},
    {"name": "commenting", "indicator": "comments_per_month", "terms": _terms("trapezoidal", low=[0.0, 0.0, 0.15, 0.4], medium=[0.25, 0.4, 0.6, 0.75], high=[0.6, 0.8, 1.0, 1.0])},
    {"name": "reactions", "indicator": "reactions_per_month", "terms": _terms("gaussian", low=[0.0, 0.2], medium=[0.5, 0.18], high=[1.0, 0.22])},
    {"name": "chat", "indicator": "chat_events_per_month", "terms": _terms("sigmoidal", low=[-12.0, 0.45], high=[12.0, 0.55])},
    {"name": "topic_access", "indicator": "topic_accesses_per_month", "terms": _terms("trapezoidal", low=[0.0, 0.0, 0.2, 0.45], medium=[0.3, 0.45, 0.6, 0.75], high=[0.6, 0.8, 1.0, 1.0])},
    {"name": "logins", "indicator": "logins_per_month", "terms": _terms("trapezoidal", low=[0.0, 0.0, 0.25, 0.55], high=[0.45, 0.75, 1.0, 1.0])},
    {"name": "mobile_channel", "indicator": "mobile_login_share", "normalisation": "none", "terms": _terms("trapezoidal", web_oriented=[0.0, 0.0, 0.3, 0.6], mobile_oriented=[0.4, 0.7, 1.0, 1.0])},
    {"name": "working_hours", "kind": "hour_profile", "window": [6, 8, 16, 18]},
    {"name": "weekend_activity", "indicator": "weekend_share", "normalisation": "none", "terms": _terms("trapezoidal", weekdays_only=[0.0, 0.0, 0.08, 0.25], weekend_active=[0.15, 0.3, 1.0, 1.0])},
    {"name": "weekly_rhythm", "indicator": "weekday_entropy", "normalisation": "none", "terms": _terms("trapezoidal", concentrated=[0.0, 0.0, 0.55, 0.8], spread=[0.65, 0.9, 1.0, 1.0])},
    {"name": "age", "indicator": "age_band_midpoint", "normalisation": "none", "terms": _terms("trapezoidal", young=[0, 0, 25, 35], mid=[25, 35, 45, 55], senior=[45, 55, 120, 120])},
)


@dataclass(frozen=True)
class Feature:
    """A fuzzy variable: an indicator with terms, or the hour profile with a window."""

    name: str
    indicator: str = ""
    terms: Mapping[str, Membership] = field(default_factory=dict)
    normalisation: str = "log_minmax"
    window: Membership | None = None
    filter_level: float | None = None
    filter_terms: tuple[str, ...] = ()
    category: str = ""

    @classmethod
    def parse(cls, spec: Mapping, default: str = "log_minmax") -> Feature:
        cut = spec.get("alpha_cut") or {}
        level = check_alpha(cut["level"]) if cut else None
        common = {"name": spec["name"], "filter_level": level, "category": spec.get("category", "")}
        if spec.get("kind") == "hour_profile":
            terms = ("working", "non_working")
            return cls(window=hour_window(spec["window"]), filter_terms=tuple(cut.get("terms", terms)) if cut else (), normalisation="none", **common)
        how, family = spec.get("normalisation", default), spec.get("family", "trapezoidal")
        if how not in NORMALISATIONS:
            raise ValueError(f"unknown normalisation {how!r}")
        given = spec.get("terms") or ["low", "medium", "high"]
        terms = {t: membership(m, family) for t, m in given.items()} if isinstance(given, Mapping) else partition(family, given)
        return cls(indicator=spec["indicator"], terms=terms, normalisation=how, filter_terms=tuple(cut.get("terms", terms)) if cut else (), **common)

    @property
    def columns(self) -> list[str]:
        return [f"{self.name}__{t}" for t in (("working", "non_working") if self.window else self.terms)]


def clean(x: Column) -> Column:
    """NaN as null."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def _scaled(x: Column, how: str) -> Column:
    return F.log1p(F.greatest(clean(x), F.lit(0.0))) if how == "log_minmax" else clean(x)


def bounds(frame: DataFrame, columns: Mapping[str, str]) -> dict[str, tuple[float, float]]:
    """Indicator -> (low, high): the 0 and 0.99 quantiles of the scaled values, exact, of all indicators at once."""
    found = exact_quantiles(frame, {c: _scaled(F.col(c), how) for c, how in columns.items()}, (0.0, UPPER_QUANTILE))
    out = {}
    for c, (lo, hi) in found.items():
        lo, hi = lo or 0.0, hi or 0.0
        out[c] = (lo, hi if hi > lo else lo + 1e-9)
    return out


def normalised(x: Column, how: str, limits: tuple[float, float] | None = None) -> Column:
    if how == "none":
        return clean(x)
    lo, hi = limits
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (_scaled(x, how) - F.lit(lo)) / F.lit(hi - lo)))


def profile_degree(windows: Mapping[str, Membership], default: Membership, pattern: Column | None = None) -> Column:
    """Share-weighted degree of the 24 hour bins; 0 without activity."""
    shares = F.expr(f"array({', '.join(f'coalesce({h}, 0D)' for h in HOURS)})")
    degrees = lambda shape: F.expr(f"array({', '.join(f'{shape.at(h + 0.5)!r}D' for h in range(24))})")
    mu = degrees(default)
    if pattern is not None:
        chosen = None
        for name, shape in windows.items():
            chosen = F.when(pattern == name, degrees(shape)) if chosen is None else chosen.when(pattern == name, degrees(shape))
        mu = mu if chosen is None else chosen.otherwise(mu)
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return share(add(F.zip_with(shares, mu, lambda a, b: a * b)), add(shares))


class Fuzzifier:
    """Fits normalisers and turns indicators into degrees."""

    def __init__(self, features: Sequence[Mapping | Feature] = DEFAULT_FEATURES, default: str = "log_minmax", shift_windows: Mapping = SHIFT_WINDOWS, levels: Sequence[float] = ALPHA_LEVELS, minimum: int = MIN_GROUP) -> None:
        self.features = [f if isinstance(f, Feature) else Feature.parse(f, default) for f in features]
        names = [f.name for f in self.features]
        if not names or len(set(names)) != len(names):
            raise ValueError("fuzzy variables need unique names, one at least")
        self.windows = {k: hour_window(v) for k, v in shift_windows.items()}
        self.levels = [check_alpha(a) for a in levels]
        self.minimum = minimum
        self.limits: dict[str, tuple[float, float]] = {}

    @property
    def columns(self) -> list[str]:
        return [c for f in self.features for c in f.columns]

    def fit(self, frame: DataFrame) -> Fuzzifier:
        need = [f.indicator for f in self.features if not f.window] + (HOURS if any(f.window for f in self.features) else [])
        missing = [c for c in need if c not in frame.columns]
        if missing:
            raise KeyError(f"the frame lacks {missing}")
        fitted = {f.indicator: f.normalisation for f in self.features if f.normalisation in ("minmax", "log_minmax")}
        if len({(f.indicator, f.normalisation) for f in self.features if f.indicator in fitted}) != len(fitted):
            raise ValueError("an indicator can be normalised in one way only")
        self.limits = bounds(frame, fitted)
        return self

    def transform(self, frame: DataFrame, id_col: str = "user_id", pattern: Column | None = None) -> DataFrame:
        """(id, feature__term...), with the alpha filters of the features applied."""
        inputs, out = [], []
        for i, f in enumerate(self.features):
            if f.window:
                inputs.append(profile_degree(self.windows, f.window, pattern).alias(f"_{i}"))
                degrees = {"working": F.col(f"_{i}"), "non_working": F.lit(1.0) - F.col(f"_{i}")}
            else:
                if f.normalisation == "quantile":
                    frame = with_cume_dist(frame, clean(F.col(f.indicator)), f"_share_{f.indicator}")
                    x = F.col(f"_share_{f.indicator}")
                else:
                    x = normalised(F.col(f.indicator), f.normalisation, self.limits.get(f.indicator))
                if max(m.support()[1] for m in f.terms.values()) == 1.0:
                    x = F.least(x, F.lit(1.0))  # a share above 1 by rounding is on the shoulder, not beyond it
                inputs.append(x.alias(f"_{i}"))
                degrees = {t: F.coalesce(m.of(F.col(f"_{i}")), F.lit(0.0)) for t, m in f.terms.items()}
            for term, mu in degrees.items():
                mu = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mu))
                if term in f.filter_terms:
                    mu = F.when(mu >= f.filter_level, mu).otherwise(0.0)
                out.append(mu.alias(f"{f.name}__{term}"))
        # Two projections: each input is computed once, however many terms refer to it.
        return frame.select(id_col, *inputs).select(id_col, *out)

    def fit_transform(self, frame: DataFrame, id_col: str = "user_id", pattern: Column | None = None) -> DataFrame:
        return self.fit(frame).transform(frame, id_col, pattern)

    def describe(self) -> list[dict]:
        rows = []
        for f in self.features:
            shapes = {"working": f.window, "non_working": Complement(f.window)} if f.window else f.terms
            rows += [{"category": f.category, "feature": f.name, "indicator": f.indicator or "hour_profile", "term": t, "normalisation": f.normalisation, "alpha_cut": f.filter_level if t in f.filter_terms else None, **m.describe()} for t, m in shapes.items()]
        return rows


def alpha_report(fuzzy: DataFrame, columns: Sequence[str], levels: Sequence[float] = ALPHA_LEVELS, minimum: int = MIN_GROUP) -> DataFrame:
    """(attribute, alpha, size, share, reportable) from one pass; empty groups are reportable."""
    sums = [F.struct(F.lit(c).alias("attribute"), F.lit(float(a)).alias("alpha"), F.count(F.when(alpha_cut(F.col(c), a), 1)).alias("size")) for c in columns for a in levels]
    rows = fuzzy.agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("r")).select("n", F.explode("r").alias("r"))
    return rows.select("r.attribute", "r.alpha", "r.size", share(F.col("r.size"), F.col("n")).alias("share"), ((F.col("r.size") == 0) | (F.col("r.size") >= minimum)).alias("reportable"))


def segment_stability(fuzzy: DataFrame, columns: Sequence[str], low: float = 0.2, high: float = 0.8) -> DataFrame:
    """(attribute, stability): users at the high level as a part of those at the low one; null if there are none."""
    parts = [F.struct(F.lit(c).alias("attribute"), F.try_divide(F.count(F.when(alpha_cut(F.col(c), high), 1)).cast("double"), F.count(F.when(alpha_cut(F.col(c), low), 1))).alias("stability")) for c in columns]
    return fuzzy.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")
