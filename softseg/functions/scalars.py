"""Scalar expressions of the compliance and hierarchy layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points for words in job titles, by length of the word, then by this order.
POSITION_POINTS = {
    "chief": 20, "ceo": 20, "cfo": 18, "coo": 18, "president": 18, "vice president": 14, "director": 12, "head": 10,
    "general manager": 9, "regional manager": 8, "manager": 6, "assistant manager": 4, "supervisor": 4, "team lead": 4,
    "lead": 3, "specialist": 2, "coordinator": 2, "associate": 1, "assistant": 1, "sales": 0, "cashier": 0, "intern": 0,
}
# Points for words that grade a position.
GRADE_POINTS = {"executive": 6, "senior": 2, "expert": 1, "principal": 3, "junior": -1, "trainee": -1}
# Countries by region.
EUROPE = ("CH", "DE", "FR", "IT", "ES", "GB", "UK", "NL", "BE", "AT", "PT", "SE", "DK", "NO", "FI", "PL", "GR", "IE")
NORTH_AMERICA = ("US", "CA", "MX")
# Limits of age bands and of role categories.
AGE_LIMITS = (18, 25, 35, 45, 55, 65, 100)
ROLE_LIMITS = ((0, 3, "frontline"), (3, 8, "supervisory"), (8, 1000, "management"))


def pseudonym(value: Column, salt: str, length: int = 12) -> Column:
    """``p`` and the first hex digits of a salted SHA-256; null stays null."""
    return F.concat(F.lit("p"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), value.cast("string")), 256), 1, length))


def title_score(title: Column, category: Column | None = None, points: Mapping[str, int] = POSITION_POINTS, grades: Mapping[str, int] = GRADE_POINTS) -> Column:
    """Points of the position words in a title, longest first, each once and then blanked out, and of the grade words; 0 at least.

    Words are matched anywhere, also inside others.
    """
    text = F.coalesce(title, F.lit(""))
    if category is not None:
        text = F.concat_ws(" ", text, category)
    text = F.lower(text)
    rest, total = text, F.lit(0)
    for word in sorted(points, key=len, reverse=True):
        total = total + F.when(F.contains(rest, F.lit(word)), points[word]).otherwise(0)
        rest = F.replace(rest, F.lit(word), F.lit(" "))
    for word, worth in grades.items():
        total = total + F.when(F.contains(text, F.lit(word)), worth).otherwise(0)
    return F.greatest(total, F.lit(0))


def role_category(score: Column) -> Column:
    out = None
    for lo, hi, name in ROLE_LIMITS:
        inside = (score >= lo) & (score < hi)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise("nan")


def region(country: Column) -> Column:
    code = F.upper(country)
    return F.when(code.isin(*EUROPE), "europe").when(code.isin(*NORTH_AMERICA), "north_america").otherwise("other")


def _band(age: Column, limits: Sequence[int], value, missing) -> Column:
    out = None
    for lo, hi in zip(limits, limits[1:]):
        inside = (age >= lo) & (age < hi)
        out = F.when(inside, value(lo, hi)) if out is None else out.when(inside, value(lo, hi))
    return out.otherwise(missing)


def age_band(age: Column, limits: Sequence[int] = AGE_LIMITS) -> Column:
    return _band(age, limits, lambda lo, hi: f"{lo}-{hi - 1}", F.lit("nan"))


def age_band_midpoint(age: Column, limits: Sequence[int] = AGE_LIMITS) -> Column:
    return _band(age, limits, lambda lo, hi: F.lit((lo + hi) / 2), F.lit(None).cast("double"))


def share(part: Column, whole: Column) -> Column:
    """part / whole; 0 where that has no value."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
