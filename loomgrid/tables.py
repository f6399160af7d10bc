"""Tables: reading, writing to the shared folder, numbering rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder shared by driver and executors: spark.checkpoint.dir. Where that is unset, a folder of our own
    if all runs on this machine (tests), an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or _LOCAL.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='loomgrid-')}")
    return f"{root.rstrip('/')}/loomgrid/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """df written as a new table in the shared folder and read again."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomgrid_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by `materialise` that nothing reads any more."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._loomgrid_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _numbered(placed: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 0 by (_part, _at): counts of parts are summed on the driver, one number a partition."""
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    starts = placed.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _start long")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") - F.col("_part") * F.lit(1 << 33)).drop("_part", "_at", "_start")


def number_by_order(df: DataFrame, columns: list[str], name: str = "row_id", keep: list[str] | None = None) -> DataFrame:
    """Rows (their columns `keep`, or all) numbered from 0 in the order of columns: a range-partitioned sort, never one task
    for all rows.

    Written before numbering, as range bounds are sampled and must not change between counting and use.
    """
    ordered = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    ordered = ordered.select(*keep) if keep else ordered
    return _numbered(materialise(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})), name)


def number_lines(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Rows of a file scan numbered from 0 in file order."""
    return _numbered(df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)


def cells(df: DataFrame, row: Column, values: Column) -> DataFrame:
    """The relation (row_id, col, val) of dense rows."""
    return df.select(row.cast("long").alias("row_id"), F.posexplode(values).alias("col", "val")).withColumn("val", F.col("val").cast("double"))
