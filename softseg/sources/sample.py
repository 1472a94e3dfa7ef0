"""A synthetic case, made by Spark: users of four archetypes and their events.

Every value follows from hashes of ids and the seed, so the tables are the same
in any partitioning and grow to any size.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from softseg.operators.counts import recent_post

from .schema import EVENT_TYPES, CaseTables

#: Events per month by type, and the share of events within the shift, of the archetypes; then their share of users.
ARCHETYPES = {
    "high": ({"post.created": 6, "comment.created": 9, "reaction.created": 45, "chat.message.sent": 150, "login": 45, "stream.viewed": 80, "topic.viewed": 70, "post.read": 90, "search.performed": 12}, 0.58, 0.10),
    "low": ({"post.created": 0.1, "comment.created": 0.2, "reaction.created": 3, "chat.message.sent": 4, "login": 8, "stream.viewed": 18, "topic.viewed": 13, "post.read": 12, "search.performed": 1}, 0.60, 0.28),
    "browsers": ({"post.created": 0.6, "comment.created": 1.3, "reaction.created": 15, "chat.message.sent": 21, "login": 35, "stream.viewed": 110, "topic.viewed": 95, "post.read": 60, "search.performed": 20}, 0.66, 0.32),
    "reactive": ({"post.created": 1.2, "comment.created": 3.7, "reaction.created": 42, "chat.message.sent": 58, "login": 30, "stream.viewed": 48, "topic.viewed": 42, "post.read": 70, "search.performed": 6}, 0.51, 0.30),
}
SHIFTS = {"office": [(8, 17)], "day": [(7, 16)], "night": [(21, 29)], "short": [(9, 13)], "long": [(7, 19)], "split": [(8, 12), (14, 18)]}
DEPARTMENTS = ("Operations", "Sales", "Ground Services", "IT", "HR", "Finance")
COUNTRIES = ("CH", "DE", "FR", "GB", "US", "CA", "BR")
TITLES = ("Sales Associate", "Team Lead", "Manager", "Senior Specialist", "Director", "Junior Coordinator")


@dataclass(frozen=True)
class Options:
    n_users: int = 400
    n_days: int = 42
    seed: int = 7
    start: datetime = datetime(2025, 3, 3)


def uniform(seed: int, *keys) -> Column:
    """In [0, 1), from the keys and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _of(u: Column, values) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def _normal(u: Column, v: Column) -> Column:
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * 3.141592653589793 * v)


def _users(spark: SparkSession, o: Options) -> DataFrame:
    ids = spark.range(o.n_users).select(F.format_string("u%05d", "id").alias("user_id"))
    r = lambda name: uniform(o.seed, F.col("user_id"), F.lit(name))
    kind, at, total = None, 0.0, sum(share for _, _, share in ARCHETYPES.values())
    for name, (_, _, share) in ARCHETYPES.items():
        at += share / total
        kind = F.when(r("kind") < at, name) if kind is None else kind.when(r("kind") < at, name)
    shift = F.when(F.col("employee_category") == "office-based", "office").otherwise(_of(r("shift"), [s for s in SHIFTS if s != "office"]))
    return ids.select(
        "user_id", F.concat(F.lit("Person "), "user_id").alias("full_name"), F.concat(F.lit("login_"), "user_id").alias("username"), _of(r("title"), TITLES).alias("job_title"),
        _of(r("department"), DEPARTMENTS).alias("department"), _of(r("division"), ("North", "South")).alias("division"), _of(r("country"), COUNTRIES).alias("country"),
        F.lit("ZRH").alias("airport"), F.lit("A").alias("terminal"), _of(r("category"), ("office-based", "shift-based")).alias("employee_category"),
        (18 + F.floor(r("age") * 47)).cast("int").alias("age"), _of(r("language"), ("en", "de", "fr")).alias("preferred_language"), kind.otherwise("reactive").alias("archetype"),
    ).withColumn("shift_pattern", shift)


def _poisson(mean: Column, u: Column, v: Column) -> Column:
    """About Poisson: inverse sums below a mean of 12, a rounded normal above."""
    small = F.aggregate(
        F.sequence(F.lit(1), F.lit(40)), F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n")),
        lambda s, i: F.struct((s["p"] * mean / i).alias("p"), (s["c"] + s["p"] * mean / i).alias("c"), (s["n"] + (s["c"] < u).cast("int")).alias("n")), lambda s: s["n"],
    )
    return F.when(mean < 12, small).otherwise(F.greatest(F.lit(0), F.round(mean + F.sqrt(mean) * _normal(u, v)))).cast("int")


def _hour(shift: Column, u: Column, v: Column, w: Column, inside: Column) -> Column:
    """Hour of an event: in one of the shift's windows with chance ``inside``, else anywhere."""
    within = None
    for name, windows in SHIFTS.items():
        at = None
        for i, (lo, hi) in enumerate(windows):
            value = F.lit(float(lo)) + u * float(hi - lo)
            at = value if at is None else F.when(v * len(windows) < i, at).otherwise(value)
        within = F.when(shift == name, at) if within is None else within.when(shift == name, at)
    return F.pmod(F.when(w < inside, within.otherwise(u * 24)).otherwise(u * 24), F.lit(24.0))


def generate(spark: SparkSession, options: Options = Options()) -> tuple[CaseTables, DataFrame]:
    """The case, and (user_id, archetype) as ground truth."""
    o = options
    people = _users(spark, o)
    months = o.n_days / 30.4375
    rates = F.create_map(*[x for a, (per, _, _) in ARCHETYPES.items() for t, n in per.items() for x in (F.lit(f"{a}|{t}"), F.lit(float(n)))])
    inside = F.create_map(*[x for a, (_, share, _) in ARCHETYPES.items() for x in (F.lit(a), F.lit(share))])
    kinds = people.select("user_id", "archetype", "shift_pattern", F.explode(F.array(*map(F.lit, EVENT_TYPES))).alias("event_type"))
    r = lambda name, *more: uniform(o.seed, F.col("user_id"), F.col("event_type"), F.lit(name), *more)
    noise = F.exp(0.25 * _normal(uniform(o.seed, F.col("user_id"), F.lit("n")), uniform(o.seed, F.col("user_id"), F.lit("m"))))
    n = _poisson(F.try_element_at(rates, F.concat_ws("|", "archetype", "event_type")) * months * noise, r("u"), r("v"))
    each = kinds.withColumn("n", n).filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    i = F.col("i")
    hour = _hour(F.col("shift_pattern"), r("h", i), r("w", i), r("s", i), F.try_element_at(inside, "archetype"))
    day = F.floor(r("d", i) * o.n_days)
    seconds = (day * 86400 + hour * 3600).cast("bigint")
    stamp = F.lit(o.start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    events = each.select(
        F.xxhash64("user_id", "event_type", "i").alias("event_id"), "user_id", stamp.alias("timestamp"), "event_type", F.concat(F.lit("/"), F.replace("event_type", F.lit("."), F.lit("/"))).alias("normalised_path"),
        F.when(F.col("event_type").rlike("created|sent"), "POST").otherwise("GET").alias("method"), _of(r("c", i), ("web", "mobile", "web")).alias("client"), F.lit(None).cast("string").alias("object_type"), F.lit(None).cast("string").alias("object_id"),
    )
    streams = spark.range(12).select(F.format_string("s%02d", "id").alias("stream_id"), F.format_string("Stream %d", "id").alias("stream_name"), F.when(F.col("id") < 4, "broadcast").otherwise("discussion").alias("stream_type"), (F.col("id") >= 4).cast("int").alias("restricted"))
    named = [f"s{k:02d}" for k in range(4, 12)]
    permissions = people.select("user_id", F.explode(F.array(*map(F.lit, named))).alias("stream_id"))
    permissions = permissions.withColumn("can_access", (uniform(o.seed, F.col("user_id"), F.col("stream_id")) < 0.6).cast("int"))
    created = events.filter("event_type = 'post.created'")
    q = lambda name: uniform(o.seed, F.col("event_id"), F.lit(name))
    posts = created.select(F.format_string("post%s", F.hex("event_id")).alias("post_id"), F.col("user_id").alias("author_id"), _of(q("stream"), [f"s{k:02d}" for k in range(12)]).alias("stream_id"), F.col("timestamp").alias("created_at"), (q("video") < 0.15).cast("int").alias("has_video"), F.floor(q("mentions") * 3).cast("int").alias("mention_count"))

    def on_posts(kind: str) -> DataFrame:
        own = events.filter(F.col("event_type") == kind)
        asks = own.select(F.struct("event_id", "user_id").alias("id"), F.col("timestamp").alias("ts"), uniform(o.seed, F.col("event_id"), F.lit("pick")).alias("pick"))
        return recent_post(asks, posts).select(F.hex("id.event_id").alias("key"), "post_id", F.col("id.user_id").alias("user_id"), F.col("ts").alias("created_at"))

    comments = on_posts("comment.created").select(F.concat(F.lit("c"), "key").alias("comment_id"), "post_id", F.col("user_id").alias("author_id"), "created_at", F.floor(uniform(o.seed, F.col("key")) * 4).cast("int").alias("like_count"))
    kinds_of = ("like", "celebrate", "support", "insightful")
    reactions = on_posts("reaction.created").select(F.concat(F.lit("r"), "key").alias("reaction_id"), "post_id", "user_id", "created_at", _of(uniform(o.seed, F.col("key")), kinds_of).alias("reaction_type"))
    talk = comments.groupBy("post_id").agg(F.count(F.lit(1)).alias("comment_count"), F.sum("like_count").alias("comment_like_count"))
    likes = reactions.groupBy("post_id").agg(F.count(F.lit(1)).alias("like_count"))
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    posts = posts.join(talk, "post_id", "left").join(likes, "post_id", "left").select(*posts.columns, whole("comment_count"), whole("like_count"), whole("comment_like_count"))
    groups = people.select("user_id", F.col("department").alias("group_id")).union(people.select("user_id", "division")).withColumn("group_name", F.col("group_id"))
    jurisdiction = F.when(F.col("country") == "US", "US").otherwise("EU")
    consent = people.select("user_id", jurisdiction.alias("jurisdiction"), F.when((F.col("country") != "US") | (uniform(o.seed, F.col("user_id"), F.lit("consent")) < 0.7), 1).otherwise(0).alias("consent"))
    case = CaseTables(people.drop("archetype"), events, posts, comments, reactions, streams, permissions, groups, consent, o.start, o.start + timedelta(days=o.n_days) - timedelta(seconds=1))
    return case, people.select("user_id", "archetype")
