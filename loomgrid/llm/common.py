"""What the operators of this subpackage share: tables, the shared folder, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that are hashed at a time; bounds the memory of `word_hashes`.
BLOCK_BYTES = 1 << 20
#: Bytes of a batch that Python works on, about; texts may be long.
BATCH_BYTES = 4 << 20

U64 = np.uint64
_LOCAL: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own if all runs
    on this machine (tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='loomgrid-')}")


def materialise(df: DataFrame) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgrid/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgrid_path = path
    return out


class Tables:
    """Tables that a computation writes on its way; `result` keeps the last one and deletes the others."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def hold(self, df: DataFrame) -> DataFrame:
        self.made.append(materialise(df))
        return self.made[-1]

    def result(self, df: DataFrame) -> DataFrame:
        out = materialise(df)
        discard(*self.made)
        self.made.clear()
        return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `materialise` that nothing reads any more."""
    for df in tables:
        path = df._loomgrid_path
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even if body uses it inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and the offsets of each (nulls are empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_table(lower: bool) -> np.ndarray:
    table = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    if lower:
        table[65:91] = table[97:123]
    return table


_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + (1 << 14))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            run = np.full(size, U64(base))
            run[0] = 1
            _POWERS[name] = np.cumprod(run, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and for each text the index of its first word (one more at the end).

    Words are `[^\\x20\\x09-\\x0D]+`; with lower, A-Z count as a-z. Works block by block, cut at white space,
    so memory beyond the result is bounded unless one word is longer than a block.
    """
    table = _byte_table(lower)
    hashes: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + BLOCK_BYTES)
        while end < n:  # cut after white space
            tail = np.flatnonzero(_IS_SPACE[raw[at:end]])
            if len(tail):
                end = at + int(tail[-1]) + 1
                break
            end = min(n, end + BLOCK_BYTES)
        part = raw[at:end]
        word = ~_IS_SPACE[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        cuts = off[np.searchsorted(off, at) : np.searchsorted(off, end)] - at  # texts that start in this block
        cuts = cuts[(cuts > 0) & (cuts < len(part))]
        first[cuts] |= word[cuts]
        s = np.flatnonzero(first)
        if len(s):
            up, down = _powers(len(part) + 1)
            run = np.zeros(len(part) + 1, U64)
            value = table[part]
            value *= up[: len(part)]
            value[~word] = 0
            np.cumsum(value, out=run[1:])
            nxt = np.append(s[1:], len(part))
            h = (run[nxt] - run[s]) * down[s]
            hashes.append(mix64(h))
            starts.append(s + at)
        at = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, off)


def batches(it: Iterator[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches that have rows, cut until they hold about `size` bytes or one row, so that few long texts are worked on at a time."""
    for b in it:
        waiting = [b] if b.num_rows else []
        while waiting:
            b = waiting.pop()
            if b.num_rows > 1 and b.nbytes > size:
                half = b.num_rows // 2
                waiting += [b.slice(half), b.slice(0, half)]
            else:
                yield b


def release_memory() -> None:
    """Hand what the allocators keep of freed memory back, as Python workers are used again and hold it meanwhile."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def public_tokenizer(name: str) -> str:
    """Where a vocabulary file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
