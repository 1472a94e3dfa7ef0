"""Daily counts per user from a stream of events, and indicators rolled up from them.

Counts add up over days, so a stream that appends closed days feeds the same
roll-up as a batch; a day is closed once the watermark has passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softseg.sources.schema import EVENT_TYPES

LATE = "1 day"


def daily_counts(events: DataFrame, late: str = LATE) -> DataFrame:
    """(user_id, day, n_events, n_<type>...) of a streaming or batch frame."""
    stamped = events.withColumn("at", F.col("timestamp").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("at", late)
    kinds = [F.count(F.when(F.col("event_type") == t, 1)).alias(f"n_{t.replace('.', '_')}") for t in EVENT_TYPES]
    days = stamped.groupBy("user_id", F.window("at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n_events"), *kinds)
    return days.select("user_id", F.to_date("w.start").alias("day"), "n_events", *[f"n_{t.replace('.', '_')}" for t in EVENT_TYPES])


def write_daily(events: DataFrame, path: str, checkpoint: str, late: str = LATE):
    """Append closed days to the Parquet table at ``path``; runs over what is there and stops."""
    return daily_counts(events, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def roll_up(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, active_days, n_events, n_<type>...) over all days of the table."""
    days = spark.read.parquet(path)
    sums = [F.sum(c).alias(c) for c in days.columns if c.startswith("n_")]
    return days.groupBy("user_id").agg(F.count_distinct("day").alias("active_days"), *sums)
