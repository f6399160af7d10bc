"""Value dictionaries and counts of batches, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_dictionary(cells: DataFrame, by: list[str], position: list[str], key: list[str]) -> DataFrame:
    """by, key, value_id: the distinct keys of each group, numbered by first appearance.

    Only the distinct keys of a group are sorted, after minima taken map-side.
    """
    first = cells.groupBy(*by, *key).agg(F.min(F.struct(*position)).alias("_first"))
    order = Window.partitionBy(*by).orderBy("_first")
    return first.withColumn("value_id", (F.row_number().over(order) - 1).cast("int")).drop("_first")


def ragged_counts(codes: DataFrame, by: list[str], column: str = "codes") -> DataFrame:
    """by, num_elements and max_element of arrays per group (0 and null for empty groups)."""
    return codes.groupBy(*by).agg(F.sum(F.size(column)).cast("long").alias("num_elements"), F.max(F.array_max(column)).alias("max_element"))


def lookup(ids: DataFrame, dictionary: DataFrame, by: list[str]) -> DataFrame:
    """The values behind value ids: the join that indexed access stands for."""
    return ids.join(dictionary, [*by, "value_id"])
