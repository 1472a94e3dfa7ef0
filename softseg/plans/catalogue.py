"""Every registered query and its SQL.

Queries read the given tables whole.  Where an operator needs the tables of a
case, ``softseg.sources.driver_tables`` derives them.  Results are rounded, as
sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from softseg.functions import membership as mf
from softseg.functions import scalars
from softseg.operators import compliance, counts, fuzzify, heuristics, indicators, profiles, ranks, rules, scale
from softseg.sources import driver_tables as src
from softseg.sources.store import materialise
from softseg.streaming import daily

from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SALT = "softseg"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import catalogue_clusters, catalogue_models  # noqa: F401  they register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


def rnd(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) as {name}"


def _ind(spark: SparkSession, d: str) -> DataFrame:
    return indicators.indicators(src.api_events(spark, d), src.users(spark, d))


def _with_people(spark: SparkSession, d: str) -> DataFrame:
    people = compliance.generalise_demographics(src.users(spark, d))
    return _ind(spark, d).join(people, "user_id")


# Sources and compliance.


@query(" union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in ("events", "customer", "orders", "lineitem", "nation", "documents", "embeddings", "pages", "labels", "conversations")))
def scan_summary(spark, d):
    out = None
    for t in ("events", "customer", "orders", "lineitem", "nation", "documents", "embeddings", "pages", "labels", "conversations"):
        part = src.table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = part if out is None else out.union(part)
    return out


@query(f"with {S.EVENTS}, {S.CONSENT} select user_id, count(*) as n_events from ev where user_id in (select user_id from co where consent = 1) group by 1")
def consent_filter(spark, d):
    kept = compliance.with_consent(src.api_events(spark, d), src.consent(spark, d))
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))


@query(f"with {S.CONSENT} select count(*) as before_users, count(case when consent = 1 then 1 end) as after_users, count(case when consent = 1 then 1 end) * 1e0 / count(*) as coverage from co")
def consent_coverage(spark, d):
    return compliance.consent_coverage(src.users(spark, d), src.consent(spark, d))


@query(f"select 'p' || substr(sha256('{SALT}:' || cast(c_custkey as varchar)), 1, 12) as user_id, c_mktsegment as department from customer")
def pseudonymise(spark, d):
    case = compliance.pseudonymise(src.case(spark, d), SALT)
    return case.users.select("user_id", "department")


@query(f"with {S.USERS} select user_id, {S.AGE_BAND} as age_band, {S.AGE_MID} as age_band_midpoint, {S.REGION} as region, department, employee_category, shift_pattern from us")
def generalise_demographics(spark, d):
    return compliance.generalise_demographics(src.users(spark, d))


@query(f"with {S.USERS} select {S.AGE_BAND} as age_band, {S.REGION} as region, employee_category, count(*) as size from us group by 1, 2, 3")
def demographic_group_sizes(spark, d):
    return compliance.demographic_group_sizes(compliance.generalise_demographics(src.users(spark, d)))


@query(f"with {S.USERS}, g as (select {S.AGE_BAND} as age_band, {S.REGION} as region, employee_category, count(*) as size from us group by 1, 2, 3) select * from g where size < 20")
def small_demographic_groups(spark, d):
    return compliance.small_groups(demographic_group_sizes(spark, d))


@query("select conv_id, turn, role from conversations")
def content_drop(spark, d):
    return compliance.drop_columns(src.table(spark, d, "conversations"), compliance.CONTENT_COLUMNS)[0]


@query(f"with {S.USERS}, {S.CONSENT} select department, count(*) as n_users from us join co using (user_id) where consent <> 1 group by 1")
def users_without_consent(spark, d):
    granted = src.consent(spark, d).filter("consent = 1")
    return src.users(spark, d).join(granted, "user_id", "left_anti").groupBy("department").agg(F.count(F.lit(1)).alias("n_users"))


@query()
def feature_space_check(spark, d):
    """Each column of the user vectors with its verdict and the number of users it has a value for."""
    frame = _with_people(spark, d)
    bad = set(compliance.forbidden_features(frame.columns))
    filled = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).isNotNull().cast("long").alias("v")) for c in frame.columns])).alias("p")
    return frame.select(filled).groupBy("p.feature").agg(F.sum("p.v").alias("n_values")).withColumn("allowed", ~F.col("feature").isin(*bad) if bad else F.lit(True))


# Indicators.


def _some(*names: str) -> tuple[Query, str]:
    sql = f"with {S.INDICATORS} select user_id, {', '.join(rnd(n, n) for n in names)} from ind"
    return (lambda spark, d: rounded(_ind(spark, d).select("user_id", *names))), sql


for _name, _cols in {
    "monthly_rates": [c for c in indicators.SCALARS if c.endswith("_per_month")],
    "login_by_client": ["logins_web_per_month", "logins_mobile_per_month", "mobile_login_share"],
    "active_days_share": ["active_days_share"],
    "working_hours_share": ["working_hours_share", "non_working_hours_share"],
    "weekend_share": ["weekend_share"],
    "weekday_entropy": ["weekday_entropy"],
    "hour_profile": indicators.HOURS,
    "dow_profile": indicators.WEEKDAYS,
    "activity_composition": ["authoring_share", "reactive_share", "consumption_share"],
    "comment_working_hours": ["comment_working_hours_share"],
    "indicators_full": [*indicators.SCALARS, *indicators.HOURS, *indicators.WEEKDAYS],
}.items():
    _QUERIES[_name], _SQL[_name] = _some(*_cols)


@query(f"with {S.EVENTS}, {S.COUNTS} select user_id, {', '.join(f'n_{t}' for t in sorted(k.replace('.', '_') for p in src.EVENT_ROLES.values() for k in set(p)))} from cn")
def event_counts_pivot(spark, d):
    frame = indicators.user_counts(src.api_events(spark, d), indicators.Period.of(src.api_events(spark, d)))
    return frame.select("user_id", *[f"n_{t}" for t in sorted(k.replace(".", "_") for p in src.EVENT_ROLES.values() for k in set(p))])


@query("with " + S.INDICATORS + " " + " union all ".join(
    f"select '{c}' as indicator, count({c}) as n, {rnd(f'avg({c})', 'mean')}, {rnd(f'stddev_samp({c})', 'std')}, {rnd(f'min({c})', 'min')}, "
    + ", ".join(rnd(f"quantile_cont({c}, {q / 100})", f"p{q}") for q in (25, 50, 75)) + f", {rnd(f'max({c})', 'max')} from ind" for c in indicators.SCALARS))
def indicator_summary(spark, d):
    return rounded(indicators.summary(_ind(spark, d).select("user_id", *indicators.SCALARS)))


_DAILY = sorted({k.replace(".", "_") for p in src.EVENT_ROLES.values() for k in p})


@query(f"with {S.EVENTS} select user_id, cast(cast(timestamp as date) as varchar) as day, count(*) as n_events, {', '.join(f"count(case when replace(event_type, '.', '_') = '{k}' then 1 end) as n_{k}" for k in _DAILY)} from ev group by 1, 2")
def daily_counts(spark, d):
    """The batch twin of the streaming roll-up."""
    return daily.daily_counts(src.api_events(spark, d)).select("user_id", F.col("day").cast("string").alias("day"), "n_events", *[f"n_{k}" for k in _DAILY])


# Heuristics.


@query(f"with {S.USERS} select user_id, {S.title_score('job_title')} as hierarchy_score from us")
def hierarchy_score(spark, d):
    return heuristics.hierarchy(src.users(spark, d)).select("user_id", "hierarchy_score")


@query(f"with {S.USERS}, h as (select {S.title_score('job_title')} as hierarchy_score from us) select {S.ROLE} as role_category, count(*) as n from h group by 1")
def role_category(spark, d):
    return heuristics.hierarchy(src.users(spark, d)).groupBy("role_category").agg(F.count(F.lit(1)).alias("n"))


_ENGAGING = """en as (
  select *, case when comment_count > round_even(avg(comment_count) over (partition by stream_id), 0)
                  and (has_video > 0 or like_count > round_even(avg(like_count) over (partition by stream_id), 0)) then 1 else 0 end as engaging
  from po)"""


@query(f"with {S.POSTS}, {_ENGAGING} select post_id, engaging from en")
def engaging_posts(spark, d):
    return heuristics.engaging_posts(src.posts(spark, d)).select("post_id", "engaging")


@query(f"""with {S.POSTS}, {_ENGAGING},
n as (select post_id, comment_count * 1e0 as a, like_count * 1e0 as b, has_video * 1e0 as c, engaging * 1e0 as e,
             sqrt(comment_count * comment_count * 1e0 + like_count * like_count + has_video + engaging) as l from en),
q as (select * from n where post_id % 100 = 0),
s as (select q.post_id, n.post_id as other_id, coalesce((q.a * n.a + q.b * n.b + q.c * n.c + q.e * n.e) / nullif(q.l * n.l, 0), 0e0) as similarity from q, n where q.post_id <> n.post_id)
select post_id, round(max(similarity), 6) as best, count(case when similarity >= 0.99e0 then 1 end) as n_close from s group by 1""")
def post_similarity_topk(spark, d):
    """Every post whose id is divisible by 100, against all posts: best similarity and number of close ones."""
    posts = heuristics.engaging_posts(src.posts(spark, d))
    return rounded(heuristics.post_similarity(posts.filter("post_id % 100 = 0"), posts))


@query("""with a as (select o_custkey as user_id, o_orderkey as post_id from orders union all select l_suppkey, l_orderkey from lineitem union all select user_id, event_id from events where event_type = 'click')
select user_id, post_id, count(*) as n from a group by 1, 2""")
def post_activity(spark, d):
    return heuristics.post_activity(src.posts(spark, d), src.comments(spark, d), src.reactions(spark, d))


_ACCESS = """ac as (
  select c_custkey as user_id,
         (select count(*) from st where stream_id not in (select stream_id from pe)) + coalesce(own, 0) as accessible_streams,
         (select count(*) from st where stream_type = 'broadcast' and stream_id not in (select stream_id from pe)) + coalesce(own_b, 0) as b
  from customer left join (select user_id, count(*) as own, count(case when stream_type = 'broadcast' then 1 end) as own_b
                           from pe join st using (stream_id) where can_access = 1 group by 1) on user_id = c_custkey),
acc as (select user_id, accessible_streams, coalesce(b * 1e0 / nullif(accessible_streams, 0), 0e0) as broadcast_stream_share from ac)"""


@query(f"with {S.STREAMS}, {S.PERMISSIONS}, {_ACCESS} select user_id, accessible_streams, {rnd('broadcast_stream_share', 'broadcast_stream_share')} from acc")
def stream_accessibility(spark, d):
    return rounded(heuristics.stream_accessibility(src.users(spark, d), src.streams(spark, d), src.stream_permissions(spark, d)))


@query(f"with {S.PERMISSIONS} select stream_id, max(can_access) as any_access, count(*) as n, sum(can_access)::bigint as n_access from pe group by 1")
def permission_matrix(spark, d):
    m = heuristics.permission_matrix(src.stream_permissions(spark, d))
    return m.groupBy("stream_id").agg(F.max("can_access").alias("any_access"), F.count(F.lit(1)).alias("n"), F.sum("can_access").alias("n_access"))


@query(f"""with {S.USERS}, {S.POSTS}, {_ENGAGING}, {S.STREAMS}, {S.PERMISSIONS}, {_ACCESS},
h as (select user_id, {S.title_score('job_title')} as hierarchy_score from us),
a as (select author_id as user_id, count(*) as n, sum(engaging) as e from en group by 1),
t as (select user_id, count(*) as n from (select o_custkey as user_id from orders union all select l_suppkey from lineitem union all select user_id from events where event_type = 'click') group by 1)
select h.user_id, hierarchy_score, {S.ROLE} as role_category, cast(case when h.user_id % 2 = 0 then 2 else 1 end as bigint) as group_memberships, accessible_streams,
       {rnd('broadcast_stream_share', 'broadcast_stream_share')}, coalesce(a.n, 0) as posts_authored, cast(coalesce(a.e, 0) as bigint) as engaging_posts_authored, coalesce(t.n, 0) as post_interactions
from h join acc using (user_id) left join a using (user_id) left join t using (user_id)""")
def heuristic_attributes(spark, d):
    return rounded(heuristics.heuristic_attributes(src.case(spark, d)))


# Membership functions, over columns of the tables.


def _mf(name: str, shape: mf.Membership, table: str, key: str, column: str, sql: str) -> None:
    _QUERIES[name] = lambda spark, d: rounded(src.table(spark, d, table).select(key, shape.of(F.col(column)).alias("mu")))
    _SQL[name] = f"select {key}, {rnd(sql, 'mu')} from {table}"


_HOUR = "(hour(ts) + minute(ts) / 60.0e0)"
_mf("mf_trapezoidal", mf.Trapezoid(50_000, 147_013, 250_000, 397_019), "orders", "o_orderkey", "o_totalprice", S.trapezoid("o_totalprice", 50_000, 147_013, 250_000, 397_019))
_mf("mf_triangular", mf.Triangle(0, 2_500, 9_000), "customer", "c_custkey", "c_acctbal", S.trapezoid("c_acctbal", 0, 2_500, 2_500, 9_000))
_mf("mf_gaussian", mf.Gaussian(30, 10), "events", "event_id", "value", S.gaussian("value", 30, 10))
_mf("mf_sigmoidal", mf.Sigmoid(0.15, 25), "events", "event_id", "value", S.sigmoid("value", 0.15, 25))
_mf("mf_complement", mf.Complement(mf.Gaussian(20, 15)), "events", "event_id", "value", f"1e0 - {S.gaussian('value', 20, 15)}")


def _by_hour(name: str, shape: mf.Membership, sql: str) -> None:
    _QUERIES[name] = lambda spark, d: rounded(src.table(spark, d, "events").select("event_id", shape.of(indicators.hour_of_day(F.col("ts"))).alias("mu")))
    _SQL[name] = f"select event_id, {rnd(sql, 'mu')} from events"


_by_hour("mf_wraparound", mf.WrapAround(20, 22, 4, 6), S.wrap(_HOUR, 20, 22, 4, 6))
_by_hour("mf_split_shift", mf.hour_window(fuzzify.SHIFT_WINDOWS["split"]), S.window(fuzzify.SHIFT_WINDOWS["split"], _HOUR))


@query(f"select event_type, {rnd('min(value)', 'lo')}, {rnd('max(value)', 'hi')}, count(*) as n from events where {S.gaussian('value', 30, 10)} >= 0.5e0 group by 1")
def mf_alpha_interval(spark, d):
    """Observed interval of the 0.5-cut of a Gaussian, by event type."""
    inside = src.table(spark, d, "events").filter(mf.alpha_cut(mf.Gaussian(30, 10).of(F.col("value")), 0.5))
    return rounded(inside.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n")))


_PARTITION = {t: m.parameters() for t, m in mf.partition("trapezoidal", ["low", "medium", "high"], -1000.0, 10_000.0).items()}


@query(f"select c_custkey, {', '.join(rnd(S.trapezoid('c_acctbal', *p), t) for t, p in _PARTITION.items())} from customer")
def linguistic_partition(spark, d):
    terms = mf.partition("trapezoidal", ["low", "medium", "high"], -1000.0, 10_000.0)
    return rounded(src.table(spark, d, "customer").select("c_custkey", *[m.of(F.col("c_acctbal")).alias(t) for t, m in terms.items()]))


def _norm(how: str) -> Query:
    def run(spark, d):
        t = src.table(spark, d, "events").select("event_id", "value")
        if how == "quantile":
            return rounded(ranks.with_cume_dist(t, F.col("value"), "x").select("event_id", "x"))
        limits = fuzzify.bounds(t, {"value": how}).get("value")
        return rounded(t.select("event_id", fuzzify.normalised(F.col("value"), how, limits).alias("x")))

    return run


for _how, _x in (("norm_log_minmax", "ln(1 + greatest(value, 0e0))"), ("norm_minmax", "value")):
    _QUERIES[_how] = _norm(_how.removeprefix("norm_"))
    _SQL[_how] = f"with l as (select quantile_cont({_x}, 0.0) as lo, quantile_cont({_x}, 0.99) as hi from events) select event_id, round(greatest(0e0, least(1e0, ({_x} - lo) / (hi - lo))), 6) as x from events, l"
_QUERIES["norm_quantile"] = _norm("quantile")
_SQL["norm_quantile"] = "select event_id, round(cume_dist() over (order by value), 6) as x from events"


# Fuzzification and rules.


def _fuzzy(spark: SparkSession, d: str, pattern: bool = True) -> tuple[fuzzify.Fuzzifier, DataFrame]:
    # Fitting, rules and result read the indicators; the event log is aggregated once.
    frame = materialise(_with_people(spark, d), "indicators")
    engine = fuzzify.Fuzzifier()
    return engine, engine.fit_transform(frame, pattern=F.col("shift_pattern") if pattern else None)


_ATTRIBUTES = list(S.attributes())


@query(f"with {S.FUZZY} select user_id, {', '.join(rnd(a, a) for a in _ATTRIBUTES if not a.startswith('working'))} from fz")
def fuzzify_scalar(spark, d):
    frame = _fuzzy(spark, d)[1]
    return rounded(frame.select("user_id", *[a for a in _ATTRIBUTES if not a.startswith("working")]))


@query(f"with {S.FUZZY} select user_id, round(working_hours__working, 6) as working_hours__working, round(working_hours__non_working, 6) as working_hours__non_working from fz")
def fuzzify_hour_profile(spark, d):
    return rounded(_fuzzy(spark, d)[1].select("user_id", "working_hours__working", "working_hours__non_working"))


@query(f"with {S.FUZZY} select user_id, round(posting__high, 6) as posting__high from fz where posting__high > 0")
def alpha_cut_filter(spark, d):
    return rounded(_fuzzy(spark, d)[1].select("user_id", "posting__high").filter("posting__high > 0"))


def _near(a: str, level: float) -> str:
    return f"{a} >= {S.num(level)}"


@query("with " + S.FUZZY + " " + " union all ".join(
    f"select '{a}' as attribute, {S.num(v)} as alpha, count(case when {_near(a, v)} then 1 end) as size, round(count(case when {_near(a, v)} then 1 end) * 1e0 / count(*), 6) as share, "
    f"(count(case when {_near(a, v)} then 1 end) = 0 or count(case when {_near(a, v)} then 1 end) >= 20) as reportable from fz" for a in _ATTRIBUTES for v in fuzzify.ALPHA_LEVELS))  # fmt: skip
def alpha_cut_report(spark, d):
    engine, frame = _fuzzy(spark, d)
    return rounded(fuzzify.alpha_report(frame, engine.columns))


@query("with " + S.FUZZY + " " + " union all ".join(f"select '{a}' as attribute, round(count(case when {_near(a, 0.8)} then 1 end) * 1e0 / nullif(count(case when {_near(a, 0.2)} then 1 end), 0), 6) as stability from fz" for a in _ATTRIBUTES))
def segment_stability(spark, d):
    engine, frame = _fuzzy(spark, d)
    return rounded(fuzzify.segment_stability(frame, engine.columns))


_LOW = S.sigmoid("hierarchy_score", -1.5, 3.0)
_BROAD = S.trapezoid("broadcast_stream_share", 0.45, 0.65, 1.0, 1.0)
_SMALL = S.trapezoid("accessible_streams", 0, 0, 4, 8)
_CONTEXT = f"""{S.FUZZY}, {S.STREAMS}, {S.PERMISSIONS}, {_ACCESS},
hs as (select user_id, {S.title_score('job_title')} as hierarchy_score, us.employee_category as category, us.shift_pattern as pattern from us),
cx as (select *, least({_LOW}, {_BROAD}) as s1, {_SMALL} as s2, case when category = 'shift-based' then 1e0 else 0e0 end as s3 from hs join acc using (user_id)),
md as (select median(accessible_streams * 1e0) as m from cx where accessible_streams > 0)"""


def _context(spark: SparkSession, d: str) -> DataFrame:
    users, frame = src.users(spark, d), _with_people(spark, d)
    context = heuristics.hierarchy(users).join(heuristics.stream_accessibility(users, src.streams(spark, d), src.stream_permissions(spark, d)), "user_id")
    return frame.join(context, "user_id")


def _effect(spark: SparkSession, d: str) -> tuple[DataFrame, rules.Effect]:
    frame = _context(spark, d)
    return frame, rules.RuleLayer().apply(frame, [f["name"] for f in fuzzify.DEFAULT_FEATURES])


@query(f"with {_CONTEXT} select user_id, {rnd('s1', 'top_down_communication')}, {rnd('s2', 'opportunity_to_interact')}, {rnd('s3', 'operational_rhythm')} from cx")
def rule_firing(spark, d):
    frame, effect = _effect(spark, d)
    return rounded(frame.select("user_id", *[s.alias(n) for n, s in effect.strengths.items()]))


@query(f"with {_CONTEXT} select user_id, {rnd('1e0 - 0.5e0 * s1', 'posting')}, {rnd('1e0 - 0.5e0 * s1', 'commenting')}, {rnd('1e0 + 0.5e0 * s1', 'reactions')}, 1e0 as logins from cx")
def rule_scale_weight(spark, d):
    frame, effect = _effect(spark, d)
    return rounded(frame.select("user_id", *[effect.weights[f].alias(f) for f in ("posting", "commenting", "reactions", "logins")]))


_REL = ("topic_accesses_per_month", "reactions_per_month", "comments_per_month")


@query(f"with {_CONTEXT} select user_id, {', '.join(rnd(f'(1e0 - s2) * {c} + s2 * {c} * (case when accessible_streams > 0 then m / accessible_streams else 1e0 end)', c) for c in _REL)} from cx join ind using (user_id), md")
def rule_relative_indicator(spark, d):
    frame, effect = _effect(spark, d)
    return rounded(frame.select("user_id", *[effect.indicators[c].alias(c) for c in _REL]))


@query(f"with {_CONTEXT} select user_id, case when s3 >= 0.5e0 then pattern end as shift_pattern from cx")
def rule_shift_pattern(spark, d):
    frame, effect = _effect(spark, d)
    return frame.select("user_id", effect.shift_pattern.alias("shift_pattern"))


@query(f"with {_CONTEXT} select user_id, {', '.join(rnd(f'{a} * ' + ('(1e0 - 0.5e0 * s1)' if a.split('__')[0] in ('posting', 'commenting') else '(1e0 + 0.5e0 * s1)' if a.startswith('reactions') else '1e0'), a) for a in _ATTRIBUTES)} from fz join cx using (user_id)")
def weighted_vectors(spark, d):
    frame, effect = _effect(spark, d)
    engine = fuzzify.Fuzzifier()
    fuzzy = engine.fit_transform(frame, pattern=F.col("shift_pattern"))
    weights = frame.select("user_id", *[w.alias(f"_{f}") for f, w in effect.weights.items()])
    joined = fuzzy.join(weights, "user_id")
    return rounded(joined.select("user_id", *[(F.col(a) * F.col(f"_{a.split('__')[0]}")).alias(a) for a in engine.columns]))


# Scalers, over the order lines of a part.

_XS = ("qty", "price", "discount")
_PARTS = "pt as (select l_partkey, sum(l_quantity) as qty, sum(l_extendedprice) as price, sum(l_discount) as discount from lineitem group by 1)"


def exact_sum(name: str) -> Column:
    """Sum of doubles as decimals, so that a comparison with a bound does not depend on their order; of doubles if one is no decimal.

    A sum of doubles that is 0.5 in decimals is 0.5 or a last place off by the order of its terms.
    """
    d = F.col(name).try_cast("decimal(28, 12)")
    return F.when(F.count(d) == F.count(name), F.try_sum(d).cast("double")).otherwise(F.sum(name))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"), exact_sum("l_discount").alias("discount"))


def _scaled(name: str, run: Callable[[DataFrame], DataFrame], exprs: Callable[[str], str], stats: str = "") -> None:
    _QUERIES[name] = lambda spark, d: rounded(run(_parts(spark, d)), 5)
    _SQL[name] = f"with {_PARTS}{stats} select l_partkey, {', '.join(rnd(exprs(c), c, 5) for c in _XS)} from pt{', s' if stats else ''}"


def _stat(**measures: str) -> str:
    return ", s as (select " + ", ".join(f"{m.format(c)} as {n}_{c}" for c in _XS for n, m in measures.items()) + " from pt)"


_iqr = "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"
_scaled("log1p_transform", lambda p: scale.log1p(p, _XS), lambda c: f"ln(1 + greatest({c}, 0e0))")
_scaled("winsorize", lambda p: scale.winsorize(p, _XS), lambda c: f"least(greatest({c}, a_{c}), b_{c})", _stat(a="quantile_cont({0}, 0.01)", b="quantile_cont({0}, 0.99)"))
_scaled("robust_scale", lambda p: scale.robust_scale(p, _XS), lambda c: f"({c} - m_{c}) / (case when r_{c} = 0 then 1e0 else r_{c} end)", _stat(m="median({0})", r=_iqr))
_scaled("standard_scale", lambda p: scale.standard_scale(p, _XS), lambda c: f"({c} - m_{c}) / (case when r_{c} > 1e-12 then r_{c} else 1e0 end)", _stat(m="avg({0})", r="stddev_pop({0})"))
_scaled("unit_var_scale", lambda p: scale.unit_variance(p, _XS), lambda c: f"{c} / (case when r_{c} > 1e-12 then r_{c} else 1e0 end)", _stat(r="stddev_pop({0})"))
_scaled("minmax_scale", lambda p: scale.minmax_scale(p, _XS), lambda c: f"({c} - m_{c}) / (case when r_{c} > 1e-12 then r_{c} else 1e0 end)", _stat(m="min({0})", r="max({0}) - min({0})"))
_scaled("l1_composition", lambda p: scale.l1_composition(p, _XS), lambda c: f"{c} / (qty + price + discount + 1e-12)")
_FULL = f"""{_PARTS}, lg as (select l_partkey, {', '.join(f'ln(1 + greatest({c}, 0e0)) as {c}' for c in _XS)} from pt),
q as (select {', '.join(f'quantile_cont({c}, 0.01) as a_{c}, quantile_cont({c}, 0.99) as b_{c}' for c in _XS)} from lg),
w as (select l_partkey, {', '.join(f'least(greatest({c}, a_{c}), b_{c}) as {c}' for c in _XS)} from lg, q),
s as (select {', '.join(f'median({c}) as m_{c}, {_iqr.format(c)} as r_{c}' for c in _XS)} from w)"""
_QUERIES["full_resolution"] = lambda spark, d: rounded(scale.full_resolution(_parts(spark, d), _XS), 5)
_SQL["full_resolution"] = f"with {_FULL} select l_partkey, {', '.join(rnd(f'({c} - m_{c}) / (case when r_{c} = 0 then 1e0 else r_{c} end)', c, 5) for c in _XS)} from w, s"
_scaled("impute_median", lambda p: scale.impute_median(p.withColumn("discount", F.when(F.col("discount") > 0.5, F.col("discount"))), _XS), lambda c: "coalesce(case when discount > 0.5e0 then discount end, m)" if c == "discount" else c, ", s as (select median(case when discount > 0.5e0 then discount end) as m from pt)")
_scaled("preprocess_auto", lambda p: scale.preprocess_auto(p, _XS), lambda c: f"(ln(1 + {c}) - m_{c}) / r_{c}", _stat(m="avg(ln(1 + {0}))", r="stddev_pop(ln(1 + {0}))"))


# Event counts of earlier analyses: kinds of events by user, as cells and as columns.

_KINDS = ("click", "error", "purchase", "signup", "view")
_WIDE = "wd as (select user_id, " + ", ".join(f"count(case when event_type = '{k}' then 1 end) as n_{k}" for k in _KINDS) + " from events group by 1)"


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "events").groupBy("user_id").agg(*[F.count(F.when(F.col("event_type") == k, 1)).alias(f"n_{k}") for k in _KINDS])


@query("with " + _WIDE + " select user_id, " + ", ".join(f"n_{k} as {k}" for k in _KINDS) + " from wd")
def unpack_event_counts(spark, d):
    """Counts written as cells with bare keys and read back as columns."""
    cell = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f"{k}: "), F.col(f"n_{k}").cast("string")) for k in _KINDS]), F.lit("}"))
    return counts.unpack_counts(_wide(spark, d).select("user_id", cell.alias("event_type_counts")), "event_type_counts", _KINDS)


@query("with " + _WIDE + " select user_id, n_click as click, case when user_id % 5 = 3 then 0 else n_error end as error, n_view as view, "
       "case when user_id % 5 = 4 then 7 else 0 end as with_comma, case when user_id % 5 = 4 then 8 else 0 end as with_quote, case when user_id % 5 = 1 then 2 else 0 end as twice from wd")  # fmt: skip
def unpack_count_cells(spark, d):
    """Cells in five forms, by user: bare and quoted names, JSON with numbers in quotes and nulls, names that hold a comma or a quote, names that come twice."""
    n = lambda k: F.col(f"n_{k}").cast("string")
    cells = [
        F.concat(F.lit("{click: "), n("click"), F.lit(",error:"), n("error"), F.lit(", view: "), n("view"), F.lit("}")),
        F.concat(F.lit('{"twice": 1, "click": '), n("click"), F.lit(', "error": '), n("error"), F.lit(', "twice": 2, "view": '), n("view"), F.lit("}")),
        F.concat(F.lit("{'click': "), n("click"), F.lit(", 'error': "), n("error"), F.lit(", 'view': "), n("view"), F.lit(", 'other': None}")),
        F.concat(F.lit('{"click": "'), n("click"), F.lit('", "error": null, "view": '), n("view"), F.lit("}")),
        F.concat(F.lit('{"a,b": 7, "a\\"b": 8, "click": '), n("click"), F.lit(', "error": '), n("error"), F.lit(', "view": '), n("view"), F.lit("}")),
    ]
    cell = F.coalesce(*[F.when(F.col("user_id") % 5 == i, c) for i, c in enumerate(cells)])
    found = counts.unpack_counts(_wide(spark, d).select("user_id", cell.alias("cell")), "cell", ("click", "error", "view", "a,b", 'a"b', "twice"))
    return found.withColumnsRenamed({"a,b": "with_comma", 'a"b': "with_quote"})


_GROUPED = {"created": "n_purchase + n_signup", "deleted": "n_error", "consumed": "n_view", "reacted": "n_click"}
_TOTAL = " + ".join(f"n_{k}" for k in _KINDS)


def _groups(frame: DataFrame) -> dict:
    return counts.group_sums(frame, {"created": ("n_purchase", "n_signup"), "deleted": ("n_error",), "consumed": ("n_view",), "reacted": ("n_click",)})


def _array() -> Column:
    return F.array(*[F.col(f"n_{k}").cast("double") for k in _KINDS])


@query(f"with {_WIDE} select user_id, {', '.join(f'({e}) * 1e0 as {g}' for g, e in _GROUPED.items())}, ({_TOTAL}) * 1e0 as total_events, {' + '.join(f'(case when n_{k} > 0 then 1 else 0 end)' for k in _KINDS)} as n_types from wd")
def event_groups(spark, d):
    frame = _wide(spark, d)
    v = counts.volume(_array())
    return frame.select("user_id", *[c.alias(g) for g, c in _groups(frame).items()], v["total_events"].alias("total_events"), v["n_types"].alias("n_types"))


@query(f"with {_WIDE} select user_id, {', '.join(rnd(f'({e}) / ({_TOTAL} + 1e-12)', f'share_{g}') for g, e in _GROUPED.items())}, {rnd('n_click / (n_purchase + n_signup + 1e-12)', 'react_create_ratio', 3)}, {rnd('n_error / (n_purchase + n_signup + 1e-12)', 'delete_create_ratio', 3)}, {rnd('(n_purchase + n_signup) / (n_view + 1e-12)', 'create_consume_ratio', 3)} from wd")
def event_shares(spark, d):
    frame = _wide(spark, d)
    out = counts.shares(_groups(frame), counts.volume(_array())["total_events"])
    return frame.select("user_id", *[F.round(c, 3 if n.endswith("ratio") else 6).alias(n) for n, c in out.items()])


_PLNP = " + ".join(f"-(n_{k} / ({_TOTAL} + 1e-12)) * ln(n_{k} / ({_TOTAL} + 1e-12) + 1e-12)" for k in _KINDS)


@query(f"with {_WIDE} select user_id, {rnd(_PLNP, 'entropy')}, {rnd(f'({_PLNP}) / ln({len(_KINDS)} + 1e-12)', 'normalised_entropy')} from wd")
def event_entropy(spark, d):
    return rounded(_wide(spark, d).select("user_id", counts.entropy(_array()).alias("entropy"), counts.normalised_entropy(_array()).alias("normalised_entropy")))


@query(f"with {_WIDE}, p as (select user_id, list_sort([{', '.join(f'n_{k} / ({_TOTAL} + 1e-12)' for k in _KINDS)}]) as p from wd) select user_id, {rnd(' + '.join(f'{2 * i - 6} * p[{i}] / 4e0' for i in range(1, 6)), 'gini')} from p")
def event_gini(spark, d):
    return rounded(_wide(spark, d).select("user_id", counts.gini(_array()).alias("gini")))


@query(f"""with {_WIDE}, t as (select user_id, ({_TOTAL}) * 1e0 as total, {_PLNP} as e, n_click * 1e0 as clicks from wd),
n as (select user_id, 0.5e0 * (total - min(total) over ()) / (max(total) over () - min(total) over ()) + 0.3e0 * (e - min(e) over ()) / (max(e) over () - min(e) over ())
             + 0.2e0 * (clicks - min(clicks) over ()) / (max(clicks) over () - min(clicks) over ()) as score from t)
select user_id, round(score, 6) as score from n""")
def composite_rank(spark, d):
    frame = _wide(spark, d).select("user_id", counts.volume(_array())["total_events"].alias("total"), counts.entropy(_array()).alias("e"), F.col("n_click").cast("double").alias("clicks"))
    return rounded(counts.composite_rank(frame, {"total": 0.5, "e": 0.3, "clicks": 0.2}).select("user_id", "score"))


@query(f"with {_WIDE} select user_id, round((rank() over (order by n_click desc) + rank() over (order by n_view desc) + rank() over (order by n_error desc)) / 3e0, 6) as mean_rank from wd")
def mean_rank(spark, d):
    return rounded(counts.mean_rank(_wide(spark, d), ["n_click", "n_view", "n_error"]).select("user_id", "mean_rank"))


@query("""with q as (select event_id as id, ts + interval (-(9500 - (event_id % 1000) * 2)) day as ts, (event_id % 97) / 97e0 as pick from events where event_type = 'click'),
p as (select o_orderkey as post_id, o_orderdate as created_at, row_number() over (order by o_orderdate, o_orderkey) as rank from orders),
s as (select id, q.ts, pick, count(rank) as seen from q left join p on created_at < q.ts group by 1, 2, 3),
c as (select id, seen, case when seen = 0 then 1 else cast(seen - least(seen, 60) + 1 + floor(pick * least(seen, 60)) as bigint) end as rank from s)
select id, seen, post_id from c join p using (rank)""")
def asof_recent_post(spark, d):
    clicks = src.table(spark, d, "events").filter("event_type = 'click'")
    back = F.expr("ts - make_dt_interval(9500 - (event_id % 1000) * 2)")
    asks = clicks.select(F.col("event_id").alias("id"), back.alias("ts"), ((F.col("event_id") % 97) / 97.0).alias("pick"))
    return counts.recent_post(asks, src.posts(spark, d).select("post_id", "created_at")).select("id", "seen", "post_id")


@query("select coalesce(round(avg(case when m > 1 then (quality - 1) / 4e0 else quality end), 6), 0e0) as semantic_consistency from labels, (select max(quality) as m from labels)")
def semantic_consistency(spark, d):
    """Labels of quality as ratings."""
    value = profiles.semantic_consistency(src.table(spark, d, "labels"), "quality")
    return src.table(spark, d, "labels").limit(1).select(F.round(F.lit(value or 0.0), 6).alias("semantic_consistency"))


__all__ = ["oracle_sql", "queries", "query", "rounded", "scalars"]
