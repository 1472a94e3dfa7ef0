"""DuckDB fragments of the oracle queries: the case tables and the indicators as common table expressions."""

from __future__ import annotations

from softseg.functions import scalars
from softseg.operators.fuzzify import DEFAULT_FEATURES, SHIFT_WINDOWS
from softseg.operators.indicators import DAYS_PER_MONTH
from softseg.sources.driver_tables import CATEGORIES, COUNTRIES, EVENT_ROLES, RESTRICTED, SHIFTS, TITLES


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def pick(number: str, values) -> str:
    return f"([{quoted(values)}])[cast({number} % {len(values)} as integer) + 1]"


def num(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


EVENTS = f"""ev as (
  select event_id, user_id, ts as timestamp,
         case event_type {" ".join(f"when '{k}' then case when k % 2 = 0 then '{a}' else '{b}' end" for k, (a, b) in EVENT_ROLES.items())} end as event_type,
         case when k % 3 = 0 then 'mobile' else 'web' end as client
  from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events))"""

USERS = f"""us as (
  select c_custkey as user_id, c_name as full_name, {pick("c_custkey", TITLES)} as job_title, c_mktsegment as department,
         {pick("c_nationkey", COUNTRIES)} as country, {pick("c_custkey", CATEGORIES)} as employee_category,
         {pick("c_custkey", SHIFTS)} as shift_pattern, cast(18 + c_custkey % 50 as integer) as age
  from customer)"""

CONSENT = "co as (select c_custkey as user_id, case when c_custkey % 10 = 3 then 0 else 1 end as consent from customer)"

POSTS = """po as (
  select o_orderkey as post_id, o_custkey as author_id, o_orderpriority as stream_id, o_orderdate as created_at,
         case when o_orderstatus = 'P' then 1 else 0 end as has_video, coalesce(n, 0) as comment_count, coalesce(q, 0) as like_count
  from orders left join (select l_orderkey, count(*) as n, cast(sum(l_quantity) as bigint) as q from lineitem group by 1) on l_orderkey = o_orderkey)"""

PERMISSIONS = f"""pe as (
  select c_custkey as user_id, s as stream_id, case when (c_custkey + cast(substr(s, 1, 1) as integer)) % 3 = 0 then 1 else 0 end as can_access
  from customer, (select unnest([{quoted(RESTRICTED)}]) as s))"""

STREAMS = """st as (
  select distinct o_orderpriority as stream_id, case when substr(o_orderpriority, 1, 1) in ('1', '2') then 'broadcast' else 'discussion' end as stream_type from orders)"""

HOUR = "(hour(timestamp) + minute(timestamp) / 60.0e0)"
_KINDS = sorted({t for pair in EVENT_ROLES.values() for t in pair})

COUNTS = f"""pd as (
  select cast(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000) as bigint) + 1 as n_days from ev),
cn as (
  select user_id, {", ".join(f"count(case when event_type = '{t}' then event_id end) as n_{t.replace('.', '_')}" for t in _KINDS)},
    count(case when event_type = 'login' and client = 'web' then 1 end) as n_web,
    count(case when event_type = 'login' and client = 'mobile' then 1 end) as n_mobile,
    count(*) as n_events, count(distinct cast(timestamp as date)) as n_active,
    avg(case when {HOUR} >= 8 and {HOUR} < 16 then 1e0 else 0e0 end) as work,
    avg(case when isodow(timestamp) >= 6 then 1e0 else 0e0 end) as weekend,
    avg(case when event_type = 'comment.created' then case when {HOUR} >= 8 and {HOUR} < 16 then 1e0 else 0e0 end end) as comment_work,
    {", ".join(f"count(case when isodow(timestamp) = {d + 1} then 1 end) as n_dow_{d}" for d in range(7))},
    {", ".join(f"count(case when hour(timestamp) = {h} then 1 end) as n_hour_{h:02d}" for h in range(24))}
  from ev group by user_id)"""


def _z(name: str) -> str:
    return f"coalesce({name}, 0)"


def _rate(expr: str) -> str:
    return f"({expr}) / (n_days / {DAYS_PER_MONTH}e0)"


def _share(a: str, b: str) -> str:
    return f"coalesce(({a}) * 1e0 / nullif({b}, 0), 0e0)"


_NAV = f"{_z('n_stream_viewed')} + {_z('n_topic_viewed')}"
_P = [_share(_z(f"n_dow_{d}"), _z("n_events")) for d in range(7)]
INDICATOR_SQL = {
    "posts_per_month": _rate(_z("n_post_created")),
    "comments_per_month": _rate(_z("n_comment_created")),
    "reactions_per_month": _rate(_z("n_reaction_created")),
    "chat_events_per_month": _rate(_z("n_chat_message_sent")),
    "logins_per_month": _rate(_z("n_login")),
    "logins_web_per_month": _rate(_z("n_web")),
    "logins_mobile_per_month": _rate(_z("n_mobile")),
    "mobile_login_share": _share(_z("n_mobile"), f"{_z('n_web')} + {_z('n_mobile')}"),
    "topic_accesses_per_month": _rate(_NAV),
    "post_reads_per_month": _rate(_z("n_post_read")),
    "searches_per_month": _rate(_z("n_search_performed")),
    "total_events_per_month": _rate(_z("n_events")),
    "active_days_share": f"{_z('n_active')} * 1e0 / n_days",
    "working_hours_share": "coalesce(work, 0e0)",
    "non_working_hours_share": "1e0 - coalesce(work, 0e0)",
    "weekend_share": "coalesce(weekend, 0e0)",
    "weekday_entropy": f"({' + '.join(f'(case when {p} > 0 then -({p}) * ln({p}) else 0e0 end)' for p in _P)}) / ln(7e0)",
    "comment_working_hours_share": "coalesce(comment_work, 0e0)",
    "authoring_share": _share(f"{_z('n_post_created')} + {_z('n_comment_created')}", _z("n_events")),
    "reactive_share": _share(_z("n_reaction_created"), _z("n_events")),
    "consumption_share": _share(f"{_NAV} + {_z('n_post_read')} + {_z('n_search_performed')}", _z("n_events")),
    **{f"hour_share_{h:02d}": _share(_z(f"n_hour_{h:02d}"), _z("n_events")) for h in range(24)},
    **{f"dow_share_{d}": p for d, p in enumerate(_P)},
}

INDICATORS = f"""{EVENTS},
{COUNTS},
ind as (
  select c_custkey as user_id, {", ".join(f"{e} as {c}" for c, e in INDICATOR_SQL.items())}
  from customer left join cn on user_id = c_custkey, pd)"""


def trapezoid(x: str, a: float, b: float, c: float, d: float) -> str:
    rise = f" when {x} > {num(a)} and {x} < {num(b)} then ({x} - {num(a)}) / {num(b - a)}" if a < b else ""
    fall = f" when {x} > {num(c)} and {x} < {num(d)} then ({num(d)} - {x}) / {num(d - c)}" if c < d else ""
    return f"(case when {x} >= {num(b)} and {x} <= {num(c)} then 1e0{rise}{fall} else 0e0 end)"


def gaussian(x: str, c: float, s: float) -> str:
    return f"exp(-(({x} - {num(c)}) * ({x} - {num(c)})) / {num(2 * s * s)})"


def sigmoid(x: str, a: float, c: float) -> str:
    return f"(1e0 / (1e0 + exp(greatest(-500e0, least(500e0, {num(-a)} * ({x} - {num(c)}))))))"


def shape(spec: dict, x: str) -> str:
    p = spec["params"]
    if spec["family"] == "triangular":
        return trapezoid(x, p[0], p[1], p[1], p[2])
    return {"trapezoidal": trapezoid, "gaussian": gaussian, "sigmoidal": sigmoid}[spec["family"]](x, *p)


def wrap(x: str, a: float, b: float, c: float, d: float, period: float = 24.0) -> str:
    b, c, d = ((v - a) % period for v in (b, c, d))
    return trapezoid(f"((({x} - {num(a)}) % {num(period)} + {num(period)}) % {num(period)})", 0.0, b, c, d or period)


def window(spec, x: str) -> str:
    if isinstance(spec, dict):
        return f"greatest(0e0, {', '.join(trapezoid(x, *w) for w in spec['windows'])})"
    return trapezoid(x, *spec) if list(spec) == sorted(spec) else wrap(x, *spec)


def profile(spec) -> str:
    total = " + ".join(f"hour_share_{h:02d}" for h in range(24))
    inner = " + ".join(f"hour_share_{h:02d} * {window(spec, num(h + 0.5))}" for h in range(24))
    return f"coalesce(({inner}) / nullif({total}, 0e0), 0e0)"


def pattern_profile() -> str:
    return f"(case shift_pattern {' '.join(f"when '{k}' then {profile(v)}" for k, v in SHIFT_WINDOWS.items())} else {profile([6, 8, 16, 18])} end)"


def age_case(value) -> str:
    limits = scalars.AGE_LIMITS
    return " ".join(f"when age >= {lo} and age < {hi} then {value(lo, hi)}" for lo, hi in zip(limits, limits[1:]))


AGE_BAND = f"case {age_case(lambda lo, hi: f"'{lo}-{hi - 1}'")} else 'nan' end"
AGE_MID = f"case {age_case(lambda lo, hi: num((lo + hi) / 2))} end"
REGION = f"case when upper(country) in ({quoted(scalars.EUROPE)}) then 'europe' when upper(country) in ({quoted(scalars.NORTH_AMERICA)}) then 'north_america' else 'other' end"


def title_score(title: str) -> str:
    text = f"lower(coalesce({title}, ''))"
    rest, parts = text, []
    for word in sorted(scalars.POSITION_POINTS, key=len, reverse=True):
        parts.append(f"(case when contains({rest}, '{word}') then {scalars.POSITION_POINTS[word]} else 0 end)")
        rest = f"replace({rest}, '{word}', ' ')"
    parts += [f"(case when contains({text}, '{w}') then {n} else 0 end)" for w, n in scalars.GRADE_POINTS.items()]
    return f"greatest({' + '.join(parts)}, 0)"


ROLE = "case " + " ".join(f"when hierarchy_score >= {lo} and hierarchy_score < {hi} then '{name}'" for lo, hi, name in scalars.ROLE_LIMITS) + " else 'nan' end"

_LOGGED = sorted({f["indicator"] for f in DEFAULT_FEATURES if f.get("normalisation", "log_minmax") == "log_minmax" and "indicator" in f})
LIMITS = f"lim as (select {', '.join(f'quantile_cont(ln(1 + greatest({c}, 0e0)), 0.0) as lo_{c}, quantile_cont(ln(1 + greatest({c}, 0e0)), 0.99) as hi_{c}' for c in _LOGGED)} from ind)"


def log_minmax(c: str) -> str:
    lo = f"lo_{c}"
    hi = f"(case when hi_{c} > lo_{c} then hi_{c} else lo_{c} + 1e-9 end)"
    return f"greatest(0e0, least(1e0, (ln(1 + greatest({c}, 0e0)) - {lo}) / ({hi} - {lo})))"


def attributes(filters: bool = True, patterns: bool = True) -> dict[str, str]:
    """Fuzzy attribute -> expression over ind, us and lim."""
    out = {}
    for f in DEFAULT_FEATURES:
        if f.get("kind") == "hour_profile":
            work = pattern_profile() if patterns else profile([6, 8, 16, 18])
            out |= {f"{f['name']}__working": work, f"{f['name']}__non_working": f"1e0 - {work}"}
            continue
        x = f["indicator"] if f["name"] == "age" else f"least({f['indicator']}, 1e0)" if f.get("normalisation") == "none" else f"n_{f['indicator']}"
        for term, spec in f["terms"].items():
            mu = f"coalesce({shape(spec, x)}, 0e0)"
            cut = f.get("alpha_cut")
            if filters and cut and term in cut["terms"]:
                mu = f"(case when {mu} >= {num(cut['level'])} then {mu} else 0e0 end)"
            out[f"{f['name']}__{term}"] = mu
    return out


FUZZY = f"""{INDICATORS},
{USERS},
{LIMITS},
nrm as (select ind.*, shift_pattern, employee_category, {AGE_MID} as age_band_midpoint, {', '.join(f'{log_minmax(c)} as n_{c}' for c in _LOGGED)}
        from ind join us using (user_id), lim),
fz as (select user_id, {', '.join(f'{e} as {a}' for a, e in attributes().items())} from nrm)"""

VECTORS = """vec as (select vec_id as i, label, unnest(range(1, len(embedding) + 1)) as d, unnest(embedding)::double as v from embeddings),
cen as (select label as j, d, avg(v) as c from vec group by 1, 2),
dis as (select i, j, greatest(sum((v - c) * (v - c)), 0e0) as d2 from vec join cen using (d) group by 1, 2)"""
MEMBERS = f"""{VECTORS},
mem as (select i, j, d2, power(greatest(d2, 1e-12), -1e0) / sum(power(greatest(d2, 1e-12), -1e0)) over (partition by i) as u from dis)"""
