"""Consent, pseudonyms, generalised demographics and checks of the feature space."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softseg.functions import scalars
from softseg.sources.schema import CaseTables

# Columns that identify a person or hold content, and words that no feature may be named.
DIRECT_IDENTIFIERS = ("full_name", "username", "email", "airport", "terminal")
CONTENT_COLUMNS = ("text", "message", "payload", "body", "content")
FORBIDDEN_WORDS = ("name", "fullname", "full_name", "username", "email", "phone", "text", "message", "payload", "body", "content", "user_id", "actor_id", "airport", "terminal", "age", "country")
PASSED_ON = ("division", "department", "employee_category", "shift_pattern", "preferred_language")
MIN_GROUP = 20


def owner_column(table: DataFrame, user_id_col: str = "user_id") -> str | None:
    return next((c for c in (user_id_col, "author_id") if c in table.columns), None)


def with_consent(table: DataFrame, consent: DataFrame, user_id_col: str = "user_id") -> DataFrame:
    """Rows whose user consents; without a consent row there is none."""
    key = owner_column(table, user_id_col)
    granted = consent.filter("consent = 1").select(F.col(user_id_col).alias(key)).distinct()
    return table.join(granted, key, "left_semi")


def apply_consent(case: CaseTables, required: bool = True) -> tuple[CaseTables, DataFrame | None]:
    """The case with consenting users only, and (before, after, coverage) as a frame of one row."""
    if case.consent is None or not required:
        return case, None
    untouched = {"streams", "consent"}
    kept = {n: with_consent(t, case.consent, case.user_id_col) for n, t in case.tables().items() if n not in untouched and owner_column(t, case.user_id_col)}
    return case.changed(**kept), consent_coverage(case.users, case.consent, case.user_id_col)


def consent_coverage(users: DataFrame, consent: DataFrame, user_id_col: str = "user_id") -> DataFrame:
    granted = consent.filter("consent = 1").select(user_id_col, F.lit(1).alias("yes")).distinct()
    ids = users.select(user_id_col).distinct().join(granted, user_id_col, "left")
    n = ids.agg(F.count(F.lit(1)).alias("before_users"), F.count("yes").alias("after_users"))
    return n.withColumn("coverage", F.coalesce(F.try_divide(F.col("after_users").cast("double"), F.col("before_users")), F.lit(0.0)))


def pseudonymise(case: CaseTables, salt: str, length: int = 12) -> CaseTables:
    """Users' and authors' ids as pseudonyms in every table but the streams."""
    changed = {}
    for name, table in case.tables().items():
        for c in (case.user_id_col, "author_id"):
            if name != "streams" and c in table.columns:
                table = table.withColumn(c, scalars.pseudonym(F.col(c), salt, length))
        changed[name] = table
    return case.changed(**changed)


def drop_columns(table: DataFrame, columns: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """The table without those of the columns that it has, and their names."""
    gone = [c for c in columns if c in table.columns]
    return table.drop(*gone), gone


def drop_content(case: CaseTables, columns: Sequence[str] = CONTENT_COLUMNS) -> tuple[CaseTables, list[str]]:
    changed, log = {}, []
    for name, table in case.tables().items():
        changed[name], gone = drop_columns(table, columns)
        log += [f"{name}.{c}" for c in gone]
    return case.changed(**changed), log


def generalise_demographics(users: DataFrame, limits: Sequence[int] = scalars.AGE_LIMITS, user_id_col: str = "user_id") -> DataFrame:
    """Age as band and midpoint, country as region, and the attributes that are passed on; all else is left out."""
    cols = [F.col(user_id_col)]
    if "age" in users.columns:
        cols += [scalars.age_band(F.col("age"), limits).alias("age_band"), scalars.age_band_midpoint(F.col("age"), limits).alias("age_band_midpoint")]
    if "country" in users.columns:
        cols.append(scalars.region(F.col("country")).alias("region"))
    return users.select(*cols, *[c for c in PASSED_ON if c in users.columns])


def demographic_group_sizes(demographics: DataFrame, columns: Sequence[str] = ("age_band", "region", "employee_category")) -> DataFrame:
    return demographics.groupBy(*[c for c in columns if c in demographics.columns]).agg(F.count(F.lit(1)).alias("size"))


def forbidden_features(columns: Iterable[str], exceptions: Iterable[str] = ()) -> list[str]:
    """Names that hold a forbidden word; of fuzzy attributes (``feature__term``) only whole names count."""
    allowed, bad = set(exceptions), []
    for c in columns:
        low = c.lower()
        parts = {low} if "__" in low else {low, *low.split("_")}
        if c not in allowed and parts & set(FORBIDDEN_WORDS):
            bad.append(c)
    return bad


def small_groups(sizes: DataFrame, minimum: int = MIN_GROUP, size_col: str = "size") -> DataFrame:
    return sizes.filter(F.col(size_col) < minimum)


@dataclass
class Compliance:
    violations: list[str] = field(default_factory=list)
    coverage: float | None = None
    smallest_group: int | None = None

    @property
    def level(self) -> str:
        return "High" if not self.violations else "Low"


def assess(features: Sequence[str], coverage: DataFrame | None, group_sizes: DataFrame | None, exceptions: Sequence[str] = ()) -> Compliance:
    """Forbidden feature names are violations; coverage and the smallest demographic group are reported."""
    out = Compliance([f"feature {c}" for c in forbidden_features(features, exceptions)])
    if coverage is not None:
        out.coverage = coverage.first()["coverage"]
    if group_sizes is not None:
        out.smallest_group = group_sizes.agg(F.min("size")).first()[0]
    return out
