"""The case tables derived from a star schema of customers, orders and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import CaseTables

#: Event type of the source -> event types for even and odd ``k`` in its properties.
EVENT_ROLES = {
    "view": ("stream.viewed", "topic.viewed"),
    "click": ("reaction.created", "post.read"),
    "purchase": ("post.created", "search.performed"),
    "signup": ("login", "login"),
    "error": ("comment.created", "chat.message.sent"),
}
TITLES = ("Chief Executive Officer", "Senior Manager", "General Manager", "Sales Associate", "Team Lead", "Junior Specialist", "Regional Director", "Warehouse Trainee")
SHIFTS = ("office", "day", "night", "short", "long", "split")
CATEGORIES = ("office-based", "shift-based", "office-based", "shift-based", "office-based")
COUNTRIES = ("CH", "DE", "FR", "US", "BR", "GB", "MX", "JP", "ES", "IN")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(number: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def api_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = None
    for name, (even, odd) in EVENT_ROLES.items():
        value = F.when(k % 2 == 0, even).otherwise(odd)
        kind = F.when(F.col("event_type") == name, value) if kind is None else kind.when(F.col("event_type") == name, value)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("timestamp"), kind.alias("event_type"), F.when(k % 3 == 0, "mobile").otherwise("web").alias("client"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        F.col("c_name").alias("full_name"),
        _pick(key, TITLES).alias("job_title"),
        F.col("c_mktsegment").alias("department"),
        _pick(F.col("c_nationkey"), COUNTRIES).alias("country"),
        _pick(key, CATEGORIES).alias("employee_category"),
        _pick(key, SHIFTS).alias("shift_pattern"),
        (18 + key % 50).cast("int").alias("age"),
    )


def consent(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("user_id"), F.when(key % 10 == 3, 0).otherwise(1).alias("consent"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("post_id")).agg(F.count(F.lit(1)).alias("comment_count"), F.sum("l_quantity").cast("bigint").alias("like_count"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("author_id"), F.col("o_orderpriority").alias("stream_id"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "P").cast("int").alias("has_video"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return orders.join(lines, "post_id", "left").select(*orders.columns, zero("comment_count"), zero("like_count"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("comment_id"), F.col("l_orderkey").alias("post_id"),
        F.col("l_suppkey").alias("author_id"), F.col("l_shipdate").alias("created_at"), F.col("l_quantity").cast("int").alias("like_count"),
    )


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks, each on the order with the number of the event."""
    clicks = table(spark, sf_dir, "events").filter("event_type = 'click'")
    return clicks.select(F.col("event_id").alias("reaction_id"), F.col("event_id").alias("post_id"), "user_id", F.col("ts").alias("created_at"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stream_id")).distinct()
    kind = F.when(F.substring("stream_id", 1, 1).isin("1", "2"), "broadcast").otherwise("discussion")
    return names.select("stream_id", F.col("stream_id").alias("stream_name"), kind.alias("stream_type"), (kind == "discussion").cast("int").alias("restricted"))


#: Order priorities that serve as restricted streams.
RESTRICTED = ("3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def stream_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer and each restricted stream; who may enter follows from both numbers."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.array(*map(F.lit, RESTRICTED))).alias("stream_id"))
    may = (F.col("user_id") + F.substring("stream_id", 1, 1).cast("int")) % 3 == 0
    return rows.withColumn("can_access", may.cast("int"))


def group_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market segment of every customer, and the nation of every other one."""
    c = table(spark, sf_dir, "customer")
    segment = c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("group_id"))
    nation = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("string").alias("group_id"))
    return segment.union(nation).withColumn("group_name", F.col("group_id"))


def case(spark: SparkSession, sf_dir: str) -> CaseTables:
    makers = (users, api_events, posts, comments, reactions, streams, stream_permissions, group_memberships, consent)
    return CaseTables(**{f.__name__: f(spark, sf_dir) for f in makers})
