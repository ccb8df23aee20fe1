"""Stated query sets against all rows, in blocks.

Rows of both sides are packed, partition by partition, into blocks of a bounded number of rows; pairs of
blocks meet in one row, and a numpy kernel turns two tables into result rows. Nothing is broadcast by
hand, and no row pair exists outside a kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crateflow.session import durable

#: Rows of a block of queries and of a block of the library.
ROWS, WIDE = 256, 1024


def pack(rows: DataFrame, name: str, size: int = ROWS) -> DataFrame:
    """One column of blocks: Arrow tables of up to ``size`` rows, in the order of their ``id`` if they have one."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                if "id" in part.schema.names:
                    part = part.sort_by("id")
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[name])

    return rows.mapInArrow(packed, f"{name} binary")


def packed_library(rows: DataFrame) -> DataFrame:
    """Checkpointed blocks of a library that several passes read, in at least as many partitions as there are cores."""
    least = rows.sparkSession.sparkContext.defaultParallelism
    return durable(pack(rows if rows.rdd.getNumPartitions() >= least else rows.repartition(least), "x", WIDE))


def packed_queries(rows: DataFrame, size: int = ROWS * 4) -> DataFrame:
    """Checkpointed, numbered blocks of queries, so that the tasks which meet them don't each make them anew."""
    return durable(pack(rows.repartition(2), "q", size).withColumn("n", F.monotonically_increasing_id()).select("n", "q"))


def unpack(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _met(queries: DataFrame, library: DataFrame) -> DataFrame:
    """(n, q, x): every block of queries, numbered, with every block of the library."""
    packed = library if library.columns == ["x"] else pack(library, "x", WIDE)
    asked = queries if queries.columns == ["n", "q"] else pack(queries, "q").withColumn("n", F.monotonically_increasing_id()).select("n", "q")
    return asked.crossJoin(packed)


#: Blocks of queries that a task keeps at a time.
KEPT = 32


def cross(queries: DataFrame, library: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """The kernel's rows over all pairs of blocks; ``library`` may be packed already. Both tables come in the order of ``id``."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, pa.Table] = {}
        for b in batches:
            for n, left, right in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if n not in known:
                    if len(known) >= KEPT:
                        known.clear()
                    known[n] = unpack(left.as_py())
                out = kernel(known[n], unpack(right.as_py())).select(names)
                yield from out.combine_chunks().to_batches(max_chunksize=100_000)

    return _met(queries, library).mapInArrow(run, schema)


def tally(queries: DataFrame, library: DataFrame, start: Callable[[pa.Table], object], add: Callable[[object, pa.Table, pa.Table], None], end: Callable[[object, pa.Table], pa.Table], schema: str) -> DataFrame:
    """As ``cross``, but what a task's pairs say of a block of queries is added up before it is sent."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[pa.Table, object]] = {}

        def done() -> Iterator[pa.RecordBatch]:
            for q, state in known.values():
                yield from end(state, q).select(names).combine_chunks().to_batches(max_chunksize=100_000)
            known.clear()

        for b in batches:
            for n, left, right in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if n not in known:
                    if len(known) >= KEPT:
                        yield from done()
                    q = unpack(left.as_py())
                    known[n] = q, start(q)
                q, state = known[n]
                add(state, q, unpack(right.as_py()))
        yield from done()

    return _met(queries, library).mapInArrow(run, schema)


def gather(queries: DataFrame, library: DataFrame, start: Callable[[], object], add: Callable[[object, pa.Table, pa.Table], None], end: Callable[[object], pa.Table], schema: str) -> DataFrame:
    """As ``tally``, with one state a task; ``add`` is given the same object while a block of queries stays the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, q = start(), None, None
        for b in batches:
            for n, left, right in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if n != now:
                    now, q = n, unpack(left.as_py())
                add(state, q, unpack(right.as_py()))
        yield from end(state).to_batches(max_chunksize=100_000)

    return _met(queries, library).mapInArrow(run, schema)


def closed(ids: np.ndarray, visited: pa.ChunkedArray) -> np.ndarray:
    """Which of the ascending ``ids`` each row's list holds."""
    column = visited.combine_chunks()
    out = np.zeros((len(column), len(ids)), bool)
    if len(ids) and len(column):
        wanted = column.flatten().to_numpy(zero_copy_only=False)
        r = np.repeat(np.arange(len(column)), np.diff(np.asarray(column.offsets)))
        place = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
        hit = ids[place] == wanted
        out[r[hit], place[hit]] = True
    return out


def rows_of(column: pa.ChunkedArray | pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as a float64 matrix; null rows are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = column.is_valid().to_numpy(zero_copy_only=False)
    offsets = np.asarray(column.offsets, np.int64)
    size = np.diff(offsets)
    dim = dim or (int(size[there][0]) if there.any() else 1)
    out = np.full((len(column), dim), np.nan)
    if there.any():
        flat = column.values.to_numpy(zero_copy_only=False)
        out[there] = flat[offsets[:-1][there][:, None] + np.arange(dim)]
    return out


#: Bins of a factor of two.
FINE = 1024


def level(value: Column) -> Column:
    """A bin of a double, in its order: bins are a 1,024th of a factor of two wide, so they are fine wherever values crowd."""
    size = F.abs(value)
    power = F.floor(F.log2(F.greatest(size, F.lit(1e-30))))
    bin_ = F.when(size <= 1e-30, F.lit(0)).otherwise((power + 101) * FINE + F.floor((size / F.pow(F.lit(2.0), power) - 1) * FINE))
    return F.when(value < 0, -bin_).otherwise(bin_).cast("bigint")


def levels(values: np.ndarray) -> np.ndarray:
    """``level`` of values from 0 up, in numpy; the same order, edges within rounding."""
    fraction, power = np.frexp(np.maximum(values, 1e-30))
    return np.where(values <= 1e-30, 0, (power + 100) * FINE + np.floor((fraction * 2 - 1) * FINE)).astype(np.int64)


def _running(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, before): each distinct value, its rows and the rows below it. Equal values are one before anything is sorted."""
    distinct = rows.groupBy(value).agg(F.count("*").alias("__n")).withColumn("__b", level(F.col(value)))
    offset = distinct.groupBy("__b").agg(F.sum("__n").alias("__s")).withColumn("__o", F.sum("__s").over(W.partitionBy().orderBy("__b")) - F.col("__s")).select("__b", "__o")
    inside = F.sum("__n").over(W.partitionBy("__b").orderBy(value)) - F.col("__n")
    return distinct.withColumn("__i", inside).join(offset, "__b").select(value, "__n", (F.col("__o") + F.col("__i")).alias("__before"))


def ordered_ranks(rows: DataFrame, value: str, rank: str) -> DataFrame:
    """``rank`` of each row among all rows by ``value``, ties at their average; no global sort.

    Distinct values are counted by bin; offsets of bins plus running counts inside them.
    """
    place = _running(rows, value).select(value, (F.col("__before") + (F.col("__n") + 1) / 2.0).alias(rank))
    return rows.join(place, value)


def at_positions(rows: DataFrame, value: str, positions: list[int]) -> list[float]:
    """The values at 0-based positions of the ascending order."""
    place = durable(_running(rows.where(F.col(value).isNotNull()), value))
    out = []
    for p in positions:
        hit = place.where((F.col("__before") <= p) & (F.col("__before") + F.col("__n") > p)).select(value).first()
        out.append(float("nan") if hit is None else hit[0])
    return out
