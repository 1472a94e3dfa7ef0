"""Behavioural indicators: one row per user from the event log, in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softseg.sources.schema import EVENT_TYPES, NAVIGATION

from .quantiles import exact_quantiles

DAYS_PER_MONTH = 30.4375
#: First and last hour of the crisp working window.
WORK_FROM, WORK_TO = 8.0, 16.0
HOURS = [f"hour_share_{h:02d}" for h in range(24)]
WEEKDAYS = [f"dow_share_{d}" for d in range(7)]
# Scalar indicators, in order.
SCALARS = (
    "posts_per_month", "comments_per_month", "reactions_per_month", "chat_events_per_month", "logins_per_month",
    "logins_web_per_month", "logins_mobile_per_month", "mobile_login_share", "topic_accesses_per_month",
    "post_reads_per_month", "searches_per_month", "total_events_per_month", "active_days_share", "working_hours_share",
    "non_working_hours_share", "weekend_share", "weekday_entropy", "comment_working_hours_share", "authoring_share",
    "reactive_share", "consumption_share",
)


@dataclass(frozen=True)
class Period:
    start: datetime
    end: datetime
    days_per_month: float = DAYS_PER_MONTH

    @classmethod
    def of(cls, events: DataFrame, start: datetime | None = None, end: datetime | None = None) -> Period:
        """The given window; what is missing is the first or last event of all."""
        if start is None or end is None:
            first, last = events.agg(F.min("timestamp"), F.max("timestamp")).first()
            start, end = start or first, end or last
        return cls(start or datetime(1970, 1, 1), end or datetime(1970, 1, 1))

    @property
    def days(self) -> int:
        return max((self.end - self.start).days + 1, 1)

    @property
    def months(self) -> float:
        return max(self.days / self.days_per_month, 1e-9)


def hour_of_day(ts: Column) -> Column:
    """Hours with minutes; seconds are left out."""
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def user_counts(events: DataFrame, period: Period, work_from: float = WORK_FROM, work_to: float = WORK_TO, user_id_col: str = "user_id") -> DataFrame:
    """Counts per user within the period; the only shuffle of the event log."""
    hour = "(hour(timestamp) + minute(timestamp) / 60.0D)"
    at_work = f"cast({hour} >= {work_from}D and {hour} < {work_to}D as int)"
    kinds = {f"n_{t.replace('.', '_')}": f"event_type = '{t}'" for t in EVENT_TYPES}
    kinds |= {"n_web": "event_type = 'login' and client = 'web'", "n_mobile": "event_type = 'login' and client = 'mobile'"}
    bins = {f"n_dow_{d}": f"weekday(timestamp) = {d}" for d in range(7)} | {f"n_hour_{h:02d}": f"hour(timestamp) = {h}" for h in range(24)}
    inside = events.filter(F.col("timestamp").between(F.lit(period.start).cast("timestamp_ntz"), F.lit(period.end).cast("timestamp_ntz")))
    aggregates = {
        **{name: f"count(case when {condition} then event_id end)" for name, condition in kinds.items()},
        "n_events": "count(event_id)",
        "n_rows": "count(1)",
        "n_days": "count(distinct to_date(timestamp))",
        "work": f"avg({at_work})",
        "weekend_share": "avg(cast(weekday(timestamp) >= 5 as double))",
        "comment_work": f"avg(case when event_type = 'comment.created' then {at_work} end)",
        **{name: f"count(case when {condition} then 1 end)" for name, condition in bins.items()},
    }
    return inside.groupBy(user_id_col).agg(*[F.expr(e).alias(name) for name, e in aggregates.items()])


def indicators(events: DataFrame, users: DataFrame, period: Period | None = None, user_id_col: str = "user_id", **window) -> DataFrame:
    """Every user with the scalar indicators, 24 hour shares and 7 weekday shares; users without events have zeros.

    Such a user has no working hour, so the share of non-working hours is 1.
    """
    period = period or Period.of(events)
    counts = user_counts(events, period, user_id_col=user_id_col, **window)
    n = lambda name: f"coalesce(n_{name}, 0L)"
    rate = lambda count: f"({count}) / {period.months!r}D"
    part = lambda a, b: f"coalesce(try_divide(cast({a} as double), cast({b} as double)), 0D)"
    navigation, total = f"({n('stream_viewed')} + {n('topic_viewed')})", n("events")
    weekdays = [part(n(f"dow_{d}"), n("rows")) for d in range(7)]
    entropy = " + ".join(f"(case when {p} > 0 then -{p} * ln({p}) else 0D end)" for p in weekdays)
    values = {
        "posts_per_month": rate(n("post_created")),
        "comments_per_month": rate(n("comment_created")),
        "reactions_per_month": rate(n("reaction_created")),
        "chat_events_per_month": rate(n("chat_message_sent")),
        "logins_per_month": rate(n("login")),
        "logins_web_per_month": rate(n("web")),
        "logins_mobile_per_month": rate(n("mobile")),
        "mobile_login_share": part(n("mobile"), f"({n('web')} + {n('mobile')})"),
        "topic_accesses_per_month": rate(navigation),
        "post_reads_per_month": rate(n("post_read")),
        "searches_per_month": rate(n("search_performed")),
        "total_events_per_month": rate(total),
        "active_days_share": f"{n('days')} / {float(period.days)!r}D",
        "working_hours_share": "coalesce(work, 0D)",
        "non_working_hours_share": "1D - coalesce(work, 0D)",
        "weekend_share": "coalesce(weekend_share, 0D)",
        "weekday_entropy": f"({entropy}) / ln(7D)",
        "comment_working_hours_share": "coalesce(comment_work, 0D)",
        "authoring_share": part(f"({n('post_created')} + {n('comment_created')})", total),
        "reactive_share": part(n("reaction_created"), total),
        "consumption_share": part(f"({navigation} + {n('post_read')} + {n('search_performed')})", total),
        **{HOURS[h]: part(n(f"hour_{h:02d}"), n("rows")) for h in range(24)},
        **{WEEKDAYS[d]: p for d, p in enumerate(weekdays)},
    }
    ids = users.select(user_id_col).distinct()
    return ids.join(counts, user_id_col, "left").select(user_id_col, *[F.expr(e).alias(name) for name, e in values.items()])


def scalar_columns(frame: DataFrame, user_id_col: str = "user_id") -> list[str]:
    """Number columns without the hour and weekday profiles and the id."""
    return [c for c, t in frame.dtypes if t in ("double", "float", "int", "bigint") and c != user_id_col and not c.startswith(("hour_share_", "dow_share_"))]


def summary(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(indicator, n, mean, std, min, p25, p50, p75, max), quantiles exact; one row an indicator, whatever the rows."""
    columns = columns or scalar_columns(frame)
    x = {c: F.col(c).cast("double") for c in columns}
    parts = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = frame.agg(*[f(v).alias(f"{i}:{p}") for i, v in enumerate(x.values()) for p, f in parts.items()]).first()
    at = exact_quantiles(frame, x, (0.25, 0.5, 0.75))
    rows = [(c, *(row[f"{i}:{p}"] for p in ("n", "mean", "std", "min")), *at[c], row[f"{i}:max"]) for i, c in enumerate(columns)]
    return frame.sparkSession.createDataFrame(rows, "indicator string, n long, mean double, std double, min double, p25 double, p50 double, p75 double, max double")


__all__ = ["EVENT_TYPES", "NAVIGATION", "Period", "hour_of_day", "indicators", "scalar_columns", "summary", "user_counts"]
