"""Sharding by a Feistel permutation with cycle walking over global row numbers.

A row's place is permutation(row number): shard = place mod shards, slot = place div shards. Counts of
shards differ by one at most, the shuffle is reproducible, and both directions are computable: from a row
number to its shard and slot, and from a shard and slot back to the row number, with nothing stored.

Row numbers: rows are counted by (doc_id, size, crc) inside hash buckets of a fixed number, numbered in that
order, and shifted by the counts of the buckets before. That depends on the rows alone, not on files or
partitions. Equal rows are counted, not sorted, so a third of all rows may be copies of one row.

Cases: null text has size 1 and the crc of no bytes (0). Null doc_ids sort first. Equal rows take consecutive
numbers. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, U64, batches

#: Hash buckets in which rows are numbered. Fixed, as the numbers depend on it.
BUCKETS = 4096
#: Copies of one row that are expanded together.
RUN = 1 << 16
ROUNDS = 6


class FeistelShuffle:
    """A seeded permutation of 0..n-1: a balanced Feistel network over the next even number of bits, walked until inside."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        self.n, self.seed, self.rounds = n, seed, rounds
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = U64((1 << self.half) - 1)

    def _f(self, x: np.ndarray, k: int) -> np.ndarray:
        return mix64(x + U64((0x9E3779B97F4A7C15 * (k + 1) + self.seed * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> U64(self.half), x & self.mask
        for k in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                left, right = right ^ self._f(left, k), left
            else:
                left, right = right, left ^ self._f(right, k)
        return (left << U64(self.half)) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(U64), back)
        while (far := np.flatnonzero(out >= U64(self.n))).size:
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def place(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, False)

    def row(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, True)

    def locate(self, row: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of row numbers."""
        p = self.place(row)
        return p % shards, p // shards

    def at(self, shard: np.ndarray, slot: np.ndarray, shards: int) -> np.ndarray:
        """The row number that lies at a slot of a shard."""
        return self.row(np.asarray(slot) * shards + np.asarray(shard))


def number_rows(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """rows (of the columns keys alone) with a global row number `row_no`, and their count."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    sums = dict(counted.groupBy("_b").agg(F.sum("_n").alias("n")).collect())  # a row for each of a fixed number of buckets
    before, total = {}, 0
    for b in range(buckets):
        before[b] = total
        total += sums.get(b, 0)
    offsets = rows.sparkSession.createDataFrame(list(before.items()), "_b int, _start long")
    w = Window.partitionBy("_b").orderBy(*keys)
    placed = (
        counted.withColumn("_own", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .join(F.broadcast(offsets), "_b")  # BUCKETS rows
        .withColumn("_first", F.col("_start") + F.coalesce("_own", F.lit(0)))
        .withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / RUN))))
    )
    last = F.least(F.col("_n"), (F.col("_run") + 1) * RUN) - 1
    return placed.select(*keys, F.explode(F.sequence(F.col("_first") + F.col("_run") * RUN, F.col("_first") + last)).alias("row_no")), total


def shuffle_shards(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, row_no of every row of docs."""
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = docs.select("doc_id", (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"))
    numbered, total = number_rows(rows, ["doc_id", "size", "text_crc32"])
    kind = "doc_id long, size long, text_crc32 long, row_no long, shard int, slot long"

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = FeistelShuffle(total, seed)
        for b in batches(it):
            shard, slot = order.locate(b.column("row_no").to_numpy(), shards)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard.astype(np.int32)), pa.array(slot)], ["doc_id", "size", "text_crc32", "row_no", "shard", "slot"])

    return numbered.select(F.col("doc_id").cast("long"), "size", "text_crc32", "row_no").mapInArrow(deal, kind)
