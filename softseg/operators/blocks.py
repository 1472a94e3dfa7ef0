"""Stated query rows that meet all rows of a table, block by block.

Query rows are dealt to blocks of bounded size.  A block is what the tasks of
one pass share; each task streams its rows past the block and gives one row of
results for each query, which Spark then combines.  No pair is ever a row.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softseg.sources.store import materialise

from .vectors import matrix, width

#: Bytes of a block's vectors, at most.
BLOCK_BYTES = 32 << 20
#: Queries and rows whose distances are computed at once, so that they stay in a core's cache.
TILE, STEP = 256, 1024
#: Tasks for each core of the cluster, about.
WAVES = 3

#: (vectors of the block, other columns of the block) -> (take in a batch's columns, results by column)
Meeting = Callable[[np.ndarray, Sequence[np.ndarray]], tuple[Callable[[np.ndarray, pa.RecordBatch], None], Callable[[], list]]]


def tiles(q: np.ndarray) -> Callable[[np.ndarray], Iterator[tuple[slice, np.ndarray]]]:
    """Of the rows x given later: squared distances of some of the queries at a time; each tile is overwritten by the next."""
    left = np.hstack([-2 * q, (q * q).sum(1)[:, None], np.ones((len(q), 1))])
    held = np.empty(TILE * STEP)

    def of(x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        right = np.ascontiguousarray(np.hstack([x, np.ones((len(x), 1)), (x * x).sum(1)[:, None]]).T)
        for i in range(0, len(q), TILE):
            n = min(TILE, len(q) - i)
            d2 = np.matmul(left[i : i + n], right, out=held[: n * len(x)].reshape(n, len(x)))
            yield slice(i, i + n), np.maximum(d2, 0.0, out=d2)

    return of


def meet(asked: DataFrame, rows: DataFrame, extra: Sequence[str], columns: Sequence[str], meeting: Meeting, schema: str) -> DataFrame | None:
    """Results of every task for each query of ``asked`` (nth long, x, ``extra`` numbers); none if nothing is asked.

    ``rows`` has ``x`` and ``columns``.  ``nth`` numbers the queries; the
    results of all tasks are one frame of (nth, the columns of ``schema``).
    Rows are dealt anew, to so many parts that blocks and parts together keep
    the cluster busy, however the rows lie in their files: each part gives a
    row for every query, so more parts than that would only be added up.
    """
    n, d = asked.count(), width(asked)
    if not n or not d:
        return None
    block = max(1, BLOCK_BYTES // (8 * d))
    parts = math.ceil(n / block)
    dealt = asked.select("nth", "x", *extra)
    if parts > 1:
        dealt = materialise(dealt.repartition(parts).withColumn("block", F.spark_partition_id()), "query-blocks")
    pieces = max(2, math.ceil(WAVES * rows.sparkSession.sparkContext.defaultParallelism / parts))
    source = materialise(rows.select("x", *columns).repartition(pieces), "met-rows")
    names = ["nth", *[c.split()[0] for c in schema.split(", ")]]
    out = []
    for b in range(parts):
        held = (dealt.filter(F.col("block") == b) if parts > 1 else dealt).select("nth", "x", *extra).toPandas()
        if not len(held):
            continue
        shared = rows.sparkSession.sparkContext.broadcast((held["nth"].to_numpy(), np.array(held["x"].tolist(), float), [held[c].to_numpy() for c in extra]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            nth, q, more = shared.value
            add, result = meeting(q, more)
            seen = False
            for batch in batches:
                for at in range(0, len(batch), STEP):
                    part = batch.slice(at, STEP)
                    add(matrix(part.column(0)), part)
                    seen = True
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(nth), *[pa.array(c) for c in result()]], names=names)

        out.append(source.mapInArrow(run, f"nth long, {schema}"))
    return functools.reduce(DataFrame.unionByName, out)


def distance_totals(asked: DataFrame, rows: DataFrame, n_weights: int) -> DataFrame | None:
    """(nth, t0, t1, ...): for each query the sum over all rows of its Euclidean distance times the row's weights ``w``, an array of ``n_weights``."""

    def meeting(q: np.ndarray, more: Sequence[np.ndarray]):
        total, near = np.zeros((len(q), n_weights)), tiles(q)

        def add(x: np.ndarray, batch: pa.RecordBatch) -> None:
            w = matrix(batch.column(1))
            for at, d2 in near(x):
                total[at] += np.sqrt(d2, out=d2) @ w

        return add, lambda: [np.ascontiguousarray(total[:, j]) for j in range(n_weights)]

    names = [f"t{j}" for j in range(n_weights)]
    parts = meet(asked, rows, (), ("w",), meeting, ", ".join(f"{c} double" for c in names))
    return None if parts is None else parts.groupBy("nth").agg(*[F.sum(c).alias(c) for c in names])
