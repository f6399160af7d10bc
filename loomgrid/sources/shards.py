"""Shards of encoded batches: as tables, and as files of the length-prefixed layout.

File layout (fixed, little-endian 32-bit): number of batches; for each its bytes' length, bytes, number of labels, labels.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, materialise
from .text import shard_number


def write_shards(batches: DataFrame, path: str, name: str) -> None:
    """A table partitioned by format and shard_id, with batch_id, num_rows, payload, labels."""
    batches.withColumn("format", F.lit(name)).write.mode("append").partitionBy("format", "shard_id").parquet(path)


def read_shards(spark: SparkSession, path: str, name: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Batches of a format; partitions prune to the shards start..end."""
    out = spark.read.parquet(path).where((F.col("format") == name) & (F.col("shard_id") >= start))
    return out if end is None else out.where(F.col("shard_id") < end)


def shard_bytes(batches: list[tuple[bytes, list[int]]]) -> bytes:
    """A shard file of (payload, labels)."""
    out = [struct.pack("<i", len(batches))]
    for payload, labels in batches:
        out += [struct.pack("<i", len(payload)), payload, struct.pack(f"<i{len(labels)}i", len(labels), *labels)]
    return b"".join(out)


def parse_shard(data: bytes) -> Iterator[tuple[bytes, list[int]]]:
    """The (payload, labels) of a shard file."""
    (n,), at = struct.unpack_from("<i", data), 4
    for _ in range(n):
        (size,) = struct.unpack_from("<i", data, at)
        payload = data[at + 4 : at + 4 + size]
        at += 4 + size
        (count,) = struct.unpack_from("<i", data, at)
        yield payload, list(struct.unpack_from(f"<{count}i", data, at + 4))
        at += 4 + 4 * count


def shard_files(batches: DataFrame) -> DataFrame:
    """shard_id, content: each shard as one file's bytes (a shard is the unit of memory; the layout allows 2 GiB a batch)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("batch_id")
        data = shard_bytes(list(zip(t.column("payload").to_pylist(), t.column("labels").to_pylist())))
        return pa.table({"shard_id": t.column("shard_id").slice(0, 1), "content": pa.array([data], pa.binary())})

    return batches.select("shard_id", "batch_id", "payload", "labels").groupBy("shard_id").applyInArrow(run, f"shard_id {batches.schema['shard_id'].dataType.simpleString()}, content binary")


def batches_of_files(files: DataFrame) -> DataFrame:
    """shard_id, batch_id, payload, labels of shard files (shard_id, content)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for shard, data in zip(b.column("shard_id").to_pylist(), b.column("content").to_pylist()):
                got = list(parse_shard(data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(got), pa.int32()), pa.array(range(len(got)), pa.int64()), pa.array([p for p, _ in got], pa.binary()), pa.array([y for _, y in got], pa.list_(pa.int32()))],
                    ["shard_id", "batch_id", "payload", "labels"],
                )

    return files.select(F.col("shard_id").cast("int"), "content").mapInArrow(run, "shard_id int, batch_id long, payload binary, labels array<int>")


def save_shard_files(batches: DataFrame, path: str, name: str) -> None:
    """Each shard as a file `file-<i>.<name>`: batches are drawn in order and written as they come, one at a time."""
    spark = batches.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    stored = materialise(batches.select("shard_id", "batch_id", "payload", "labels"))
    counts = {r["shard_id"]: r["count"] for r in stored.groupBy("shard_id").count().collect()}  # a row a shard
    out, now, left = None, None, 0
    for row in stored.orderBy("shard_id", "batch_id").toLocalIterator(prefetchPartitions=True):
        if row["shard_id"] != now:
            if left:
                raise RuntimeError(f"shard {now} lacks {left} batches")
            if out is not None:
                out.close()
            now, left = row["shard_id"], counts[row["shard_id"]]
            out = files.create(place(f"{path}/file-{now}.{name}"))
            out.write(struct.pack("<i", left))
        out.write(shard_bytes([(bytes(row["payload"]), row["labels"])])[4:])
        left -= 1
    if out is not None:
        out.close()
    if left:
        raise RuntimeError(f"shard {now} lacks {left} batches")
    discard(stored)


def read_shard_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Batches of foreign shard files `file-<i>.<format>`."""
    files = spark.read.format("binaryFile").load(pattern)
    return batches_of_files(files.select(shard_number(F.col("path")).alias("shard_id"), "content"))
