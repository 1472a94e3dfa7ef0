"""Shared folder for intermediate tables.

Steps that read an intermediate result more than once write it as Parquet to
the folder that the cluster names in ``spark.checkpoint.dir``.  The lineage
ends there, so a lost executor costs a re-read and never a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
#: Steps of the driver that run at once, at most.
AT_ONCE = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode a new one if unset."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` once and return the written table; ``options`` are those of the writer."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(steps: Sequence[Callable[[], T]]) -> list[T]:
    """Results of steps that need nothing of each other, in their order; the jobs of one run while another plans or waits."""
    if not steps:
        return []
    with ThreadPoolExecutor(min(AT_ONCE, len(steps))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(s)) for s in steps]]
