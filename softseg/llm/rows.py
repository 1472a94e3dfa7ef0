"""Keeping chosen rows of a table, whatever its columns are called.

A row travels as one struct beside the helper columns, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packed(docs: DataFrame, **helpers: Column) -> DataFrame:
    """(row struct of all columns, helper columns...)."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in helpers.items()])


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def row_key(id_: Column, digest: Column) -> Column:
    """16 bytes for an id, null or not, and the digest of a text; never null, so a join on it needs no null-safe comparison."""
    known = F.when(id_.isNull(), F.lit(b"0")).otherwise(F.lit(b"1"))
    return F.unhex(F.md5(F.concat(known, digest, F.coalesce(id_.cast("string"), F.lit("")).cast("binary"))))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """Rows of ``docs`` whose (id, digest) is in ``kept`` (id, digest), all columns.

    Ids match null-safely.  Rows that repeat both are one row in the result.
    The join and the numbering of repeated rows share the key by which rows are
    dealt, so a text moves once.
    """
    keyed = packed(docs, key=row_key(F.col(f"`{id_col}`"), digest))
    right = kept.select(row_key(F.col("id"), F.col("digest")).alias("keep_key"))
    joined = keyed.join(right, F.col("key") == F.col("keep_key"), "left_semi")
    once = Window.partitionBy("key").orderBy("key")
    return unpacked(joined.withColumn("nth", F.row_number().over(once)).filter("nth = 1"))
