"""Sums over vector rows, the primitive under reduction, clustering and validity.

A kernel turns a block of rows into a few totals.  Blocks run as Arrow batches
in the tasks; each task sends one row of totals, Spark adds them up, and the
driver gets as many numbers as the kernel returns, whatever the row count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from softseg.sources.store import materialise

Kernel = Callable[[np.ndarray], np.ndarray]
#: Totals from which they are added up as arrays, and groups in which that is done.
MANY, GROUPS = 4096, 16


def vector(columns: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def vector_frame(frame: DataFrame, columns: list[str], id_col: str = "user_id") -> DataFrame:
    """(id, x array<double>)."""
    return frame.select(F.col(id_col).alias("id"), vector(columns).alias("x"))


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


#: Bytes of a packed block, and blocks of one file.
PACK_BYTES, PACK_FILE = 1 << 18, 64


def packed(rows: DataFrame) -> DataFrame:
    """(x binary, d int): the vectors of ``rows`` written as blocks of doubles, which ``totals`` reads without unpacking every number.

    Iterations that read the same rows hundreds of times read them so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(0))
                step = max(1, PACK_BYTES // (8 * max(1, x.shape[1])))
                cells = [x[i : i + step].tobytes() for i in range(0, len(x), step)]
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), pa.array([x.shape[1]] * len(cells), pa.int32())], names=["x", "d"])

    return materialise(rows.select("x").mapInArrow(run, "x binary, d int"), "packed", maxRecordsPerFile=PACK_FILE)


def totals(rows: DataFrame, kernel: Kernel, size: int, more_columns: Sequence[str] = (), largest: int = 0) -> np.ndarray:
    """Sum of ``kernel(block)`` over all rows, of its first ``largest`` numbers the largest (at least 0).

    The block is the vectors ``x``, with ``more_columns`` appended; ``packed`` rows have no other columns.
    """
    blocks_ = isinstance(rows.schema["x"].dataType, BinaryType)
    names = ["x", "d"] if blocks_ else ["x", *more_columns]

    def taken(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        if blocks_:
            for cell, d in zip(batch.column(0), batch.column(1).to_pylist()):
                yield np.frombuffer(cell.as_buffer()).reshape(-1, d)
        elif len(batch):
            x = matrix(batch.column(0))
            more = [batch.column(i).to_numpy(zero_copy_only=False).astype(float)[:, None] for i in range(1, len(names))]
            yield np.hstack([x, *more]) if more else x

    def join(total: np.ndarray, more: np.ndarray) -> None:
        total[:largest] = np.maximum(total[:largest], more[:largest])
        total[largest:] += more[largest:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in taken(batch):
                join(total, np.ravel(kernel(x)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["t"])

    parts, out = rows.select(*names).mapInArrow(run, "t array<double>"), np.zeros(size)
    if size > MANY:
        # Long totals are added up as arrays, in as many groups as the driver then gets rows.
        def add(table: pa.Table) -> pa.Table:
            total = np.zeros(size)
            for row in matrix(table.column("t").combine_chunks()):
                join(total, row)
            return pa.table({"t": pa.array([total.tolist()], pa.list_(pa.float64()))})

        grouped = parts.withColumn("g", F.spark_partition_id() % GROUPS).groupBy("g").applyInArrow(lambda t: add(t), "t array<double>")
        for r in grouped.collect():
            join(out, np.array(r["t"]))
        return out
    v = F.when(F.col("i") < largest, F.max("v")).otherwise(F.sum("v")) if largest else F.sum("v")
    for r in parts.select(F.posexplode("t").alias("i", "v")).groupBy("i").agg(v.alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def with_rows(rows: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], name: str = "u") -> DataFrame:
    """``rows`` with an array column computed block by block from ``x``; adds no shuffle."""
    names = [c for c in rows.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("x")
            made = kernel(matrix(batch.column(at))) if len(batch) else np.zeros((0, 1))
            flat = pa.array(np.ascontiguousarray(made, float).ravel())
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * made.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, flat)], names=[*names, name])

    picked = rows.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields)
    return picked.mapInArrow(run, f"{schema}, `{name}` array<double>")


def squared_distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * x @ v.T, 0.0)


def width(rows: DataFrame) -> int:
    first = rows.select(F.size("x")).first()
    return 0 if first is None else first[0]


def argmax_label(u: Column) -> Column:
    """Place of the largest degree, the first of equals, from 0."""
    return (F.array_position(u, F.array_max(u)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
