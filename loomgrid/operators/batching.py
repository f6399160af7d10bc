"""Batching, sampling, projection, filter and scaling of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import EPS, draw_wide, scaled


def contiguous(rows: DataFrame, size: int) -> DataFrame:
    """batch_id and row_in_batch from row_id; the last batch may be short."""
    return rows.withColumns({"batch_id": F.floor(F.col("row_id") / size).cast("long"), "row_in_batch": (F.col("row_id") % size).cast("long")})


def draws(spark, size: int, batches: int, num_rows: int) -> DataFrame:
    """batch_id, row_in_batch, row_id of batches drawn with replacement from num_rows rows."""
    ids = spark.range(size * batches)
    return ids.select(F.floor(F.col("id") / size).cast("long").alias("batch_id"), (F.col("id") % size).alias("row_in_batch"), (draw_wide(F.col("id")) % num_rows).alias("row_id"))


def with_replacement(rows: DataFrame, size: int, batches: int, num_rows: int) -> DataFrame:
    return draws(rows.sparkSession, size, batches, num_rows).join(rows, "row_id")


def nonzero(dense: Column, eps: float = EPS) -> Column:
    """Cells of a dense row whose value is larger than eps in size."""
    pairs = F.transform(dense, lambda v, i: F.struct(i.alias("col"), v.alias("val")))
    return F.filter(pairs, lambda c: F.abs(c["val"]) > eps)


def densify(cells: Column, width: int) -> Column:
    """A dense row of cells; the last of repeated columns stays."""
    last = F.aggregate(cells, F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>")), lambda m, c: F.map_concat(F.map_filter(m, lambda k, _: k != c["col"]), F.map_from_arrays(F.array(c["col"]), F.array(c["val"]))))
    ordered = F.size(F.array_distinct(F.transform(cells, lambda c: c["col"]))) == F.size(cells)
    table = F.when(ordered, F.map_from_entries(cells)).otherwise(last)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.coalesce(F.try_element_at(table, j), F.lit(0.0)))


def drop_column(dense: Column, index: int) -> Column:
    return F.filter(dense, lambda _, i: i != index)


def scale_dense(dense: Column, factor: float) -> Column:
    return F.transform(dense, lambda v: scaled(v, factor)) if factor else dense


def scale_sparse(cells: Column, factor: float) -> Column:
    """Scaled after the zero filter: small results stay."""
    return F.transform(cells, lambda c: F.struct(c["col"].alias("col"), scaled(c["val"], factor).alias("val"))) if factor else cells


def shard_range(rows: DataFrame, start: int, end: int | None) -> DataFrame:
    """Rows of the shards start..end; without an end, of all from start."""
    out = rows.where(F.col("shard_id") >= start)
    return out if end is None else out.where(F.col("shard_id") < end)
