"""Connected components by alternating star contractions.

Each round rewires every edge to the smallest neighbour (large star, then
small star) until nothing changes; the rounds needed grow with the logarithm
of the component size.  Neighbour minima are partial aggregates, so a node
with very many edges is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, root): every node but the roots, with the smallest node it reaches.

    Self loops, repeated and null edges add nothing; no edges give no rows.
    """
    now = materialise(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = _state(now)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = materialise(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        after = _state(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    if before[0]:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return tuple(row)
