"""Ranks over a whole table without a global sort of its rows.

Distinct values are counted with partial aggregates and dealt to ranges; a
value's rank is what lies in the ranges before its own plus its place there.
What is ordered in one task is a range of distinct values, and what the ranges
share is one number each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softseg.sources.store import materialise


def value_ranks(values: DataFrame) -> DataFrame:
    """(v) -> (v, below, n, total): rows with a smaller value, with the value, and with any; nulls are left out."""
    counted = values.filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    # Written once, so that a range keeps its number wherever it is read.
    dealt = materialise(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.sum("n").alias("size"))
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.sum("size").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # One row for each range.
    return placed.join(F.broadcast(parts), "part").select("v", (F.col("base") + F.col("own")).alias("below"), "n", "total")


def _with_ranks(frame: DataFrame, value: Column) -> DataFrame:
    ranks = value_ranks(frame.select(value.alias("v"))).select(F.struct("v", "below", "n", "total").alias("_rank"))
    return frame.join(ranks, value == F.col("_rank.v"), "left")


def with_cume_dist(frame: DataFrame, value: Column, name: str) -> DataFrame:
    """``frame`` with the share of rows whose value is not larger; null for a null value, which is counted nowhere."""
    ranked = _with_ranks(frame, value)
    share = (F.col("_rank.below") + F.col("_rank.n")) / F.col("_rank.total")
    return ranked.select(*[F.col(f"`{c}`") for c in frame.columns], share.alias(name))


def with_rank(frame: DataFrame, value: Column, name: str) -> DataFrame:
    """``frame`` with the rank of the value, largest first, ties alike; nulls come last."""
    ranked = _with_ranks(frame, value)
    above = F.col("_rank.total") - F.col("_rank.below") - F.col("_rank.n")
    nulls = F.lit(frame.filter(value.isNotNull()).count())
    return ranked.select(*[F.col(f"`{c}`") for c in frame.columns], (F.coalesce(above, nulls) + 1).alias(name))
