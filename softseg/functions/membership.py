"""Membership functions as column expressions.

A membership function is a small specification; ``of(column)`` compiles it to
a Catalyst expression, so degrees are computed inside whole-stage code.  A null
or NaN input is in no bounded set: trapezoids give 0, smooth curves give null.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Membership:
    """Degree in [0, 1] of a number."""

    family = ""

    def of(self, x: Column) -> Column:
        raise NotImplementedError

    def at(self, x: float) -> float:
        """The degree of one number, on the driver: for the constants of a plan."""
        raise NotImplementedError

    def support(self) -> tuple[float, float]:
        raise NotImplementedError

    def parameters(self) -> tuple:
        return tuple(vars(self).values())

    def describe(self) -> dict:
        return {"family": self.family, "parameters": list(self.parameters()), "support": list(self.support())}


def _slope(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """Trapezoid; an edge of no width is vertical."""
    out = F.when((x >= F.lit(b)) & (x <= F.lit(c)), F.lit(1.0))
    if a < b:
        out = out.when((x > F.lit(a)) & (x < F.lit(b)), (x - F.lit(a)) / F.lit(b - a))
    if c < d:
        out = out.when((x > F.lit(c)) & (x < F.lit(d)), (F.lit(d) - x) / F.lit(d - c))
    return out.otherwise(F.lit(0.0))


def _height(x: float, a: float, b: float, c: float, d: float) -> float:
    if b <= x <= c:
        return 1.0
    return (x - a) / (b - a) if a < x < b else (d - x) / (d - c) if c < x < d else 0.0


@dataclass(frozen=True)
class Trapezoid(Membership):
    a: float
    b: float
    c: float
    d: float
    family = "trapezoidal"

    def __post_init__(self) -> None:
        if not self.a <= self.b <= self.c <= self.d:
            raise ValueError(f"a trapezoid needs a <= b <= c <= d, not {self.parameters()}")

    def of(self, x: Column) -> Column:
        return _slope(x.cast("double"), *map(float, self.parameters()))

    def at(self, x: float) -> float:
        return _height(x, self.a, self.b, self.c, self.d)

    def support(self) -> tuple[float, float]:
        return float(self.a), float(self.d)


@dataclass(frozen=True)
class Triangle(Membership):
    a: float
    b: float
    c: float
    family = "triangular"

    def __post_init__(self) -> None:
        Trapezoid(self.a, self.b, self.b, self.c)

    def of(self, x: Column) -> Column:
        return Trapezoid(self.a, self.b, self.b, self.c).of(x)

    def at(self, x: float) -> float:
        return _height(x, self.a, self.b, self.b, self.c)

    def support(self) -> tuple[float, float]:
        return float(self.a), float(self.c)


@dataclass(frozen=True)
class Gaussian(Membership):
    c: float
    sigma: float
    family = "gaussian"

    def __post_init__(self) -> None:
        if not self.sigma > 0:
            raise ValueError("a Gaussian needs a positive sigma")

    def of(self, x: Column) -> Column:
        off = x.cast("double") - F.lit(float(self.c))
        return F.exp(-(off * off) / F.lit(2.0 * self.sigma * self.sigma))

    def at(self, x: float) -> float:
        return math.exp(-((x - self.c) ** 2) / (2.0 * self.sigma * self.sigma))

    def support(self) -> tuple[float, float]:
        return self.c - 4.0 * self.sigma, self.c + 4.0 * self.sigma


@dataclass(frozen=True)
class Sigmoid(Membership):
    a: float
    c: float
    family = "sigmoidal"

    def of(self, x: Column) -> Column:
        power = F.lit(-float(self.a)) * (x.cast("double") - F.lit(float(self.c)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), power))))

    def at(self, x: float) -> float:
        return 1.0 / (1.0 + math.exp(max(-500.0, min(500.0, -self.a * (x - self.c)))))

    def support(self) -> tuple[float, float]:
        reach = 8.0 / max(abs(self.a), 1e-12)
        return self.c - reach, self.c + reach


@dataclass(frozen=True)
class WrapAround(Membership):
    """A trapezoid on a circle, as of the hours of a day; the corners may pass the end of the period."""

    a: float
    b: float
    c: float
    d: float
    period: float = 24.0
    family = "wraparound"

    def of(self, x: Column) -> Column:
        turn = F.lit(float(self.period))
        return _slope(F.pmod(x.cast("double") - F.lit(float(self.a)), turn), 0.0, *self._turned())

    def _turned(self) -> tuple[float, float, float]:
        b, c, d = ((v - self.a) % self.period for v in (self.b, self.c, self.d))
        return b, c, d or float(self.period)

    def at(self, x: float) -> float:
        return _height((x - self.a) % self.period, 0.0, *self._turned())

    def support(self) -> tuple[float, float]:
        return 0.0, float(self.period)


@dataclass(frozen=True)
class SplitShift(Membership):
    """The largest degree in any of several windows."""

    windows: tuple[tuple[float, float, float, float], ...]
    family = "split_shift"

    def of(self, x: Column) -> Column:
        return F.greatest(F.lit(0.0), *(Trapezoid(*w).of(x) for w in self.windows))

    def at(self, x: float) -> float:
        return max(0.0, *(_height(x, *w) for w in self.windows))

    def support(self) -> tuple[float, float]:
        return float(min(w[0] for w in self.windows)), float(max(w[3] for w in self.windows))


@dataclass(frozen=True)
class Complement(Membership):
    inner: Membership
    family = "complement"

    def of(self, x: Column) -> Column:
        return F.lit(1.0) - self.inner.of(x)

    def at(self, x: float) -> float:
        return 1.0 - self.inner.at(x)

    def support(self) -> tuple[float, float]:
        return self.inner.support()

    def parameters(self) -> tuple:
        return self.inner.parameters()


#: Family name -> (class, parameter names).
_FAMILIES: dict[str, tuple[type, tuple[str, ...]]] = {
    **dict.fromkeys(("trapezoidal", "trapezoid", "trap", "trapmf"), (Trapezoid, ("a", "b", "c", "d"))),
    **dict.fromkeys(("triangular", "triangle", "trimf"), (Triangle, ("a", "b", "c"))),
    **dict.fromkeys(("gaussian", "gauss"), (Gaussian, ("c", "sigma"))),
    **dict.fromkeys(("sigmoidal", "sigmoid"), (Sigmoid, ("a", "c"))),
}


def membership(spec: Mapping | Membership, family: str | None = None) -> Membership:
    """From ``{family, params: [...]}`` or named parameters; the family may come from outside."""
    if isinstance(spec, Membership):
        return spec
    name = str(spec.get("family", family)).lower()
    if name not in _FAMILIES:
        raise ValueError(f"unknown membership family {name!r}")
    kind, names = _FAMILIES[name]
    values = list(spec["params"]) if "params" in spec else [spec[n] for n in names if n in spec]
    if len(values) != len(names):
        raise ValueError(f"{name} takes {', '.join(names)}")
    return kind(*map(float, values))


def hour_window(spec: Mapping | Sequence) -> Membership:
    """A working-hour window: four corners (out of order: past midnight), or several windows."""
    if isinstance(spec, Mapping) and "windows" in spec:
        return SplitShift(tuple(tuple(map(float, w)) for w in spec["windows"]))
    if isinstance(spec, Mapping) and "family" in spec:
        return membership(spec)
    corners = [float(spec[k]) for k in "abcd"] if isinstance(spec, Mapping) else [float(v) for v in spec]
    return Trapezoid(*corners) if corners == sorted(corners) else WrapAround(*corners)


def partition(family: str, terms: Sequence[str], lo: float = 0.0, hi: float = 1.0) -> dict[str, Membership]:
    """Evenly spaced terms over [lo, hi], with shoulders at both ends."""
    n = len(terms)
    if n < 2 or not hi > lo:
        raise ValueError("a partition needs two terms or more and lo < hi")
    step, tiny = (hi - lo) / (n - 1), 1e-9
    kind = _FAMILIES[family.lower()][0]
    out: dict[str, Membership] = {}
    for i, term in enumerate(terms):
        at, first, last = lo + i * step, i == 0, i == n - 1
        if kind is Gaussian or (kind is Sigmoid and not first and not last):
            out[term] = Gaussian(at, step / 2)
        elif kind is Sigmoid:
            out[term] = Sigmoid((-1 if first else 1) * 10 / step, at + (step / 2 if first else -step / 2))
        elif kind is Triangle and not first and not last:
            out[term] = Triangle(at - step, at, at + step)
        else:
            flat = 0.0 if kind is Triangle else step / 4
            left = lo - tiny if first else at - step + flat
            right = hi + tiny if last else at + step - flat
            out[term] = Trapezoid(left, left if first else at - flat, right if last else at + flat, right)
    return out


def grid(spark: SparkSession, shape: Membership, lo: float, hi: float, points: int) -> DataFrame:
    """(x, mu) on evenly spaced points."""
    x = F.lit(float(lo)) + F.col("id") * F.lit((hi - lo) / (points - 1))
    return spark.range(points).select(x.alias("x")).withColumn("mu", shape.of(F.col("x")))


def alpha_interval(spark: SparkSession, shape: Membership, alpha: float, points: int = 2001) -> tuple[float, float] | None:
    """Smallest and largest grid point of the support with a degree of at least ``alpha``."""
    check_alpha(alpha)
    row = grid(spark, shape, *shape.support(), points).filter(F.col("mu") >= alpha).agg(F.min("x"), F.max("x")).first()
    return None if row[0] is None else (row[0], row[1])


def check_alpha(alpha: float) -> float:
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"an alpha level is between 0 and 1, not {alpha}")
    return float(alpha)


def alpha_cut(mu: Column, alpha: float, strong: bool = False) -> Column:
    """Whether the degree reaches (or, for a strong cut, exceeds) ``alpha``."""
    check_alpha(alpha)
    return mu > F.lit(float(alpha)) if strong else mu >= F.lit(float(alpha))
