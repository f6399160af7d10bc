"""Text sources: delimited numbers and LIBSVM, as rows (row_id, label, dense or cells)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import EPS, draw
from ..operators import batching
from ..tables import number_lines

_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
#: Width of LIBSVM rows unless told (fixed value).
LIBSVM_COLUMNS = 784


def numbers_of(line: Column) -> Column:
    """The numbers of a delimited line up to the first field that is none."""
    fields = F.regexp_extract_all(line, F.lit(r"[^\s,]+"), F.lit(0))
    bad = F.array_position(F.transform(fields, lambda f: f.rlike(_NUMBER)), False)
    good = F.when(bad > 0, F.slice(fields, 1, (bad - 1).cast("int"))).otherwise(fields)
    return F.when(line.rlike(r"^\s*,"), F.array().cast("array<double>")).otherwise(F.transform(good, lambda f: f.try_cast("double")))


def read_csv(spark: SparkSession, path: str, label_index: int = -1, read_rows: int = -1) -> DataFrame:
    """row_id, label, dense, cells of delimited lines; without a label column labels are drawn from row_id."""
    rows = number_lines(spark.read.text(path)).select("row_id", numbers_of(F.col("value")).alias("all"))
    if read_rows >= 0:
        rows = rows.where(F.col("row_id") < read_rows)
    if label_index < 0:
        rows = rows.select("row_id", (draw(F.col("row_id")) % 2).cast("int").alias("label"), F.col("all").alias("dense"))
    else:
        left = F.filter("all", lambda x, i: i != label_index)
        rows = rows.select("row_id", F.get("all", F.lit(label_index)).cast("int").alias("label"), left.alias("dense"))
    return rows.withColumn("cells", batching.nonzero(F.col("dense"), EPS))


def check_widths(rows: DataFrame) -> DataFrame:
    """rows, failing at the first whose width is not that of row 0."""
    first = rows.where("row_id = 0").select(F.size("dense")).first()
    if first is None:
        return rows
    wrong = F.concat(F.lit("ragged row "), F.col("row_id").cast("string"))
    return rows.withColumn("dense", F.when(F.size("dense") == first[0], F.col("dense")).otherwise(F.raise_error(wrong).cast("array<double>")))


def read_libsvm(spark: SparkSession, path: str, num_columns: int = LIBSVM_COLUMNS, read_rows: int = -1) -> DataFrame:
    """row_id, label, cells, dense of `label idx:val ...` lines; indexes count from 0, those beyond the width are dropped.

    cells keep explicit zeros and repeated indexes; in dense rows the last of repeated indexes stays.
    """
    parts = F.split(F.trim("value"), r"\s+")
    rows = number_lines(spark.read.text(path))
    if read_rows >= 0:
        rows = rows.where(F.col("row_id") < read_rows)
    pair = lambda f: F.struct(F.substring_index(f, ":", 1).cast("int").alias("col"), F.substring_index(f, ":", -1).cast("double").alias("val"))
    found = F.filter(F.transform(F.slice(parts, 2, F.size(parts)), pair), lambda c: c["col"] < num_columns)
    rows = rows.where(F.trim("value") != "").select("row_id", F.get(parts, F.lit(0)).cast("int").alias("label"), found.alias("cells"))
    return rows.withColumn("dense", batching.densify(F.col("cells"), num_columns))


def shard_number(path: Column) -> Column:
    """The number of a shard file `file-<i>.<format>`, from its path."""
    return F.regexp_extract(path, r"file-(\d+)\.[a-z]+$", 1).cast("int")


def write_libsvm_shards(rows: DataFrame, path: str) -> None:
    """rows (row_id, shard_id, label, cells) as one LIBSVM file a shard, `file-<i>.libsvm`, lines in the order of row_id."""
    spark = rows.sparkSession
    pairs = F.transform("cells", lambda c: F.concat(c["col"].cast("string"), F.lit(":"), c["val"].cast("string")))
    lines = rows.select("shard_id", "row_id", F.concat_ws(" ", F.col("label").cast("string"), F.array_join(pairs, " ")).alias("value"))
    lines.repartition("shard_id").sortWithinPartitions("shard_id", "row_id").select("shard_id", "value").write.option("maxRecordsPerFile", 0).partitionBy("shard_id").text(f"{path}/parts")
    name = spark._jvm.org.apache.hadoop.fs.Path
    files = name(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in files.globStatus(name(f"{path}/parts/shard_id=*/part-*")):  # a name a shard
        number = part.getPath().getParent().getName().split("=")[1]
        files.rename(part.getPath(), name(f"{path}/file-{number}.libsvm"))
    files.delete(name(f"{path}/parts"), True)


def read_libsvm_shards(spark: SparkSession, pattern: str, num_columns: int = LIBSVM_COLUMNS) -> DataFrame:
    """shard_id, line (in the shard), label, cells of all files of a pattern; a shard is one file."""
    lines = spark.read.text(pattern).withColumns({"shard_id": shard_number(F.col("_metadata.file_path")), "at": F.monotonically_increasing_id()})
    parts = F.split(F.trim("value"), r"\s+")
    pair = lambda f: F.struct(F.substring_index(f, ":", 1).cast("int").alias("col"), F.substring_index(f, ":", -1).cast("double").alias("val"))
    found = F.filter(F.transform(F.slice(parts, 2, F.size(parts)), pair), lambda c: c["col"] < num_columns)
    return lines.select("shard_id", "at", F.get(parts, F.lit(0)).cast("int").alias("label"), found.alias("cells"))


@dataclass
class Reader:
    """A table of rows (row_id, label, dense, cells) with the usual views of it."""

    rows: DataFrame

    def dense(self) -> DataFrame:
        return self.rows.select("row_id", "dense")

    def sparse(self) -> DataFrame:
        return self.rows.select("row_id", "cells")

    def labels(self) -> DataFrame:
        return self.rows.select("row_id", "label")

    def num_rows(self) -> int:
        return self.rows.count()

    def num_cols(self) -> int:
        return self.rows.agg(F.max(F.size("dense"))).first()[0] or 0

    def mini_batch(self, size: int, batch_id: int) -> DataFrame:
        return batching.contiguous(self.rows, size).where(F.col("batch_id") == batch_id)

    def sample(self, size: int, batches: int = 1) -> DataFrame:
        return batching.with_replacement(self.rows, size, batches, self.num_rows())
