"""Matrix operators: as relations (cells with row_id, col, val), as arrays, and on encoded batches.

A product is an equi-join on the shared index and a grouped sum. Empty rows and columns have the result 0. The
relational form lets Catalyst choose the join; the array form keeps a row together and needs no shuffle for M B; the
encoded form works on what a batch's format stores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .codecs import codec


def range_table(spark: SparkSession, n: int, name: str) -> DataFrame:
    return spark.range(n).select(F.col("id").alias(name))


def matvec(cells: DataFrame, rows: DataFrame, vector: DataFrame) -> DataFrame:
    """row_id, y: y[r] = sum over c of M[r, c] v[c]. rows: all row_ids; vector: col, x."""
    found = cells.join(vector, "col").groupBy("row_id").agg(F.sum(F.col("val") * F.col("x")).alias("y"))
    return rows.join(found, "row_id", "left").select("row_id", F.coalesce("y", F.lit(0.0)).alias("y"))


def vecmat(cells: DataFrame, vector: DataFrame, num_cols: int) -> DataFrame:
    """col, y: y[c] = sum over r of v[r] M[r, c]. vector: row_id, x."""
    found = cells.join(vector, "row_id").groupBy("col").agg(F.sum(F.col("val") * F.col("x")).alias("y"))
    cols = range_table(cells.sparkSession, num_cols, "col").select(F.col("col").cast("int"))
    return cols.join(found, "col", "left").select("col", F.coalesce("y", F.lit(0.0)).alias("y"))


def matmul(cells: DataFrame, rows: DataFrame, other: DataFrame, width: int) -> DataFrame:
    """row_id, k, y: Y = M B. other: col, k, b."""
    found = cells.join(other, "col").groupBy("row_id", "k").agg(F.sum(F.col("val") * F.col("b")).alias("y"))
    every = rows.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k"))
    return every.join(found, ["row_id", "k"], "left").select("row_id", "k", F.coalesce("y", F.lit(0.0)).alias("y"))


def transposed_matmul(cells: DataFrame, other: DataFrame, num_cols: int, width: int) -> DataFrame:
    """col, k, y: Y = M' B with B of as many rows as M. other: row_id, k, b."""
    found = cells.join(other, "row_id").groupBy("col", "k").agg(F.sum(F.col("val") * F.col("b")).alias("y"))
    every = range_table(cells.sparkSession, num_cols, "col").select(F.col("col").cast("int"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k"))
    return every.join(found, ["col", "k"], "left").select("col", "k", F.coalesce("y", F.lit(0.0)).alias("y"))


def scale(cells: DataFrame, factor: int) -> DataFrame:
    return cells.withColumn("val", F.col("val") * F.lit(factor))


def square(cells: DataFrame) -> DataFrame:
    return cells.withColumn("val", F.col("val") * F.col("val"))


def total(cells: DataFrame, column: str = "val") -> DataFrame:
    return cells.agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("total"))


def dot(dense: Column, vector: list[float]) -> Column:
    """The product of a dense row with a fixed vector, in the row: no join, no shuffle."""
    products = F.zip_with(dense, F.array(*[F.lit(float(x)) for x in vector]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)


def dense_matmul(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    """row_id, y (array): dense rows times a matrix that every task holds (its size is the caller's, as a layer's weights)."""
    sent = rows.sparkSession.sparkContext.broadcast(np.asarray(matrix, float))

    def times(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in it:
            if b.num_rows:
                x = b.column("dense").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(m))
                y = pa.FixedSizeListArray.from_arrays(pa.array((x @ m).reshape(-1)), m.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("row_id"), y], ["row_id", "y"])

    return rows.select("row_id", "dense").mapInArrow(times, "row_id long, y array<double>")


def encode_batches(rows: DataFrame, name: str, num_cols: int, keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """keys, num_rows, payload, labels of each batch of rows (keys, row_in_batch, label, cells), encoded.

    A batch is a group and bounded by its size; LZW is sequential within it and batches are encoded in parallel.
    """
    cls = codec(name)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("row_in_batch")
        lists = t.column("cells").combine_chunks()
        flat = lists.flatten()
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, values = flat.field("col").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("val").to_numpy(zero_copy_only=False).astype(float)
        if name in ("logicalfoc", "toc"):
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((at, row))
            at, values = at[order], values[order]
            if ((at[1:] == at[:-1]) & (row[1:] == row[:-1])).any():
                raise ValueError("a row names a column twice")
        out = {k: t.column(k).slice(0, 1) for k in keys}
        payload = cls.of_cells(sizes, at, values, num_cols).write()
        out |= {"num_rows": pa.array([t.num_rows], pa.int32()), "payload": pa.array([payload], pa.binary()), "labels": pa.array([t.column("label").to_pylist()], pa.list_(pa.int32()))}
        return pa.table(out)

    kind = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    ready = rows.select(*keys, "row_in_batch", F.col("label").cast("int").alias("label"), "cells")
    return ready.groupBy(*keys).applyInArrow(run, f"{kind}, num_rows int, payload binary, labels array<int>")


def on_encoded(batches: DataFrame, name: str, size: int, apply: Callable[[object, int], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """apply(decoded batch, its first row_id) for every batch; the columns it returns, as rows."""
    names = [f.split()[0] for f in schema.split(",")]
    cls = codec(name)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for batch_id, payload in zip(b.column("batch_id").to_pylist(), b.column("payload").to_pylist()):
                got = apply(cls.read(payload), batch_id * size)
                yield pa.RecordBatch.from_arrays([pa.array(got[c]) for c in names], names)

    return batches.select("batch_id", "payload").mapInArrow(run, schema)


def encoded_matvec(batches: DataFrame, name: str, size: int, vector: np.ndarray) -> DataFrame:
    def apply(m, first):
        return {"row_id": first + np.arange(m.rows), "y": m.times_vector(vector)}

    return on_encoded(batches, name, size, apply, "row_id long, y double")


def encoded_vecmat(batches: DataFrame, name: str, size: int, vector: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """vector: the entries of v at row_ids. Batches give partial sums."""

    def apply(m, first):
        v = vector(first + np.arange(m.rows))
        return {"col": np.arange(m.cols, dtype=np.int32), "y": m.vector_times(v)}

    return on_encoded(batches, name, size, apply, "col int, y double").groupBy("col").agg(F.sum("y").alias("y"))


def encoded_matmul(batches: DataFrame, name: str, size: int, other: np.ndarray) -> DataFrame:
    def apply(m, first):
        y = m.times(other)
        r, k = np.divmod(np.arange(y.size), y.shape[1])
        return {"row_id": first + r, "k": k.astype(np.int32), "y": y.reshape(-1)}

    return on_encoded(batches, name, size, apply, "row_id long, k int, y double")


def encoded_transposed_matmul(batches: DataFrame, name: str, size: int, other: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """other: the rows of B at row_ids. Batches give partial sums."""

    def apply(m, first):
        y = m.transposed_times(other(first + np.arange(m.rows)))
        c, k = np.divmod(np.arange(y.size), y.shape[1])
        return {"col": c.astype(np.int32), "k": k.astype(np.int32), "y": y.reshape(-1)}

    return on_encoded(batches, name, size, apply, "col int, k int, y double").groupBy("col", "k").agg(F.sum("y").alias("y"))


def _cells_after(change: Callable[[object], None]) -> Callable[[object, int], dict[str, np.ndarray]]:
    def apply(m, first):
        change(m)
        r, c, v = m.cells()
        return {"row_id": first + r, "col": c.astype(np.int32), "val": v}

    return apply


def encoded_scale(batches: DataFrame, name: str, size: int, factor: int) -> DataFrame:
    return on_encoded(batches, name, size, _cells_after(lambda m: m.scale(factor)), "row_id long, col int, val double")


def encoded_square(batches: DataFrame, name: str, size: int) -> DataFrame:
    return on_encoded(batches, name, size, _cells_after(lambda m: m.square()), "row_id long, col int, val double")


def encoded_total(batches: DataFrame, name: str, size: int) -> DataFrame:
    part = on_encoded(batches, name, size, lambda m, first: {"part": np.array([m.total()])}, "part double")
    return part.agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("total"))


def decoded_cells(batches: DataFrame, name: str, size: int) -> DataFrame:
    return on_encoded(batches, name, size, _cells_after(lambda m: None), "row_id long, col int, val double")
