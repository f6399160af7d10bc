"""Encodings of mini-batches: bytes of exactly known size, and matrix operators on what they hold.

An encoded batch offers the same operators whatever its format: `times(B)` is M B, `transposed_times(B)` is
M' B (vectors are matrices of one column), `scale`, `square`, `total`, `cells`. Formats with a dictionary scale and square the
dictionary only; those with LZW codes multiply along the dictionary's nodes, each shared run once.

Layouts (fixed values, little-endian): 4-byte headers; `packed` integers take 1 to 4 bytes.
mat: rows, columns, cells. csr: rows, columns, row sizes, columns, values. csrvi: rows, columns, values, width
(1 byte), row sizes, columns, packed value ids, values. dvi: rows, columns, values, width (1 byte), packed ids, values.
logicalfoc: pairs, rows, columns, nodes, pair columns, pair values, row sizes, codes. toc: widths of codes,
columns and value ids (1 byte each), pairs, values, rows, columns, nodes, packed pair columns, packed pair value ids,
values, packed row sizes, packed codes, one spare byte. gzip and snappy: the compressed bytes of mat.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

from . import lzw


def byte_width(n: int) -> int:
    return 1 if n < 1 << 8 else 2 if n < 1 << 16 else 3 if n < 1 << 24 else 4


def pack(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(np.asarray(values, "<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u4").reshape(-1).astype(np.int64)


def first_seen(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order of first appearance, and the id of each value."""
    _, first, back = np.unique(values, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return values[first[order]], rank[back]


class _Bytes:
    """Reads fields off a byte string."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def ints(self, form: str) -> tuple[int, ...]:
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def packed(self, width: int, n: int) -> np.ndarray:
        out = unpack(self.data[self.at : self.at + width * n], width)
        self.at += width * n
        return out


class _Encoded:
    """What all formats share: their size, equality of representation, products with vectors."""

    __hash__ = None

    @classmethod
    def of(cls, rows: list[list[tuple[int, float]]], cols: int) -> _Encoded:
        """A batch of rows of (column, value)."""
        flat = [x for r in rows for x in r]
        return cls.of_cells(np.array([len(r) for r in rows], np.int64), np.array([c for c, _ in flat], np.int64), np.array([v for _, v in flat], float), cols)

    def size(self) -> int:
        return len(self.write())

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.write() == other.write()

    def times_vector(self, v: np.ndarray) -> np.ndarray:
        """M v."""
        return self.times(np.asarray(v, float)[:, None])[:, 0]

    def vector_times(self, v: np.ndarray) -> np.ndarray:
        """v M."""
        return self.transposed_times(np.asarray(v, float)[:, None])[:, 0]


class Dense(_Encoded):
    """`mat`: all cells."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.rows, self.cols = x.shape

    @classmethod
    def of_cells(cls, sizes: np.ndarray, at: np.ndarray, values: np.ndarray, cols: int) -> Dense:
        """A batch of rows of so many cells, end to end; of repeated columns the last counts."""
        x = np.zeros((len(sizes), cols))
        x[np.repeat(np.arange(len(sizes)), sizes), at] = values
        return cls(x)

    @classmethod
    def read(cls, data: bytes) -> Dense:
        b = _Bytes(data)
        r, c = b.ints("II")
        return cls(b.take("<f8", r * c).reshape(r, c).copy())

    def write(self) -> bytes:
        return struct.pack("<II", self.rows, self.cols) + self.x.astype("<f8").tobytes()

    def times(self, b: np.ndarray) -> np.ndarray:
        return self.x @ b

    def transposed_times(self, b: np.ndarray) -> np.ndarray:
        return self.x.T @ b

    def scale(self, s: int) -> None:
        self.x = self.x * s

    def square(self) -> None:
        self.x = self.x * self.x

    def total(self) -> float:
        return float(self.x.sum())

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(self.x)
        return r, c, self.x[r, c]


class DenseDictionary(Dense):
    """`dvi`: ids of all cells and the values they stand for."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.rows, self.cols = ids.shape

    @classmethod
    def of_cells(cls, sizes: np.ndarray, at: np.ndarray, values: np.ndarray, cols: int) -> DenseDictionary:
        x = Dense.of_cells(sizes, at, values, cols).x
        values, ids = first_seen(x.reshape(-1))
        return cls(ids.reshape(x.shape), values)

    @classmethod
    def read(cls, data: bytes) -> DenseDictionary:
        b = _Bytes(data)
        r, c, v, w = b.ints("IIIB")
        ids = b.packed(w, r * c).reshape(r, c)
        return cls(ids, b.take("<f8", v).copy())

    def write(self) -> bytes:
        w = byte_width(len(self.values))
        return struct.pack("<IIIB", self.rows, self.cols, len(self.values), w) + pack(self.ids.reshape(-1), w) + self.values.astype("<f8").tobytes()

    @property
    def x(self) -> np.ndarray:
        return self.values[self.ids]

    def scale(self, s: int) -> None:
        self.values = self.values * s

    def square(self) -> None:
        self.values = self.values * self.values

    def total(self) -> float:
        return float(np.bincount(self.ids.reshape(-1), minlength=len(self.values)) @ self.values)


class Sparse(_Encoded):
    """`csr`: sizes of rows, columns and values of their cells."""

    def __init__(self, cols: int, sizes: np.ndarray, at: np.ndarray, values: np.ndarray):
        self.rows, self.cols, self.sizes, self.at, self.stored = len(sizes), cols, sizes, at, values
        self.row = np.repeat(np.arange(self.rows), sizes)

    @classmethod
    def of_cells(cls, sizes: np.ndarray, at: np.ndarray, values: np.ndarray, cols: int) -> Sparse:
        return cls(cols, sizes, at, values)

    @classmethod
    def read(cls, data: bytes) -> Sparse:
        b = _Bytes(data)
        r, c = b.ints("II")
        sizes = b.take("<u4", r).astype(np.int64)
        n = int(sizes.sum())
        return cls(c, sizes, b.take("<u4", n).astype(np.int64), b.take("<f8", n).copy())

    def write(self) -> bytes:
        return struct.pack("<II", self.rows, self.cols) + self.sizes.astype("<u4").tobytes() + self.at.astype("<u4").tobytes() + self.stored.astype("<f8").tobytes()

    @property
    def cell_values(self) -> np.ndarray:
        return self.stored

    def _sum_by(self, key: np.ndarray, parts: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(key, parts[:, k], n) for k in range(parts.shape[1])], 1) if parts.shape[1] else np.zeros((n, 0))

    def times(self, b: np.ndarray) -> np.ndarray:
        return self._sum_by(self.row, self.cell_values[:, None] * b[self.at], self.rows)

    def transposed_times(self, b: np.ndarray) -> np.ndarray:
        return self._sum_by(self.at, self.cell_values[:, None] * b[self.row], self.cols)

    def scale(self, s: int) -> None:
        self.stored = self.stored * s

    def square(self) -> None:
        self.stored = self.stored * self.stored

    def total(self) -> float:
        return float(self.cell_values.sum())

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.row, self.at, self.cell_values


class SparseDictionary(Sparse):
    """`csrvi`: as csr, with ids for values."""

    def __init__(self, cols: int, sizes: np.ndarray, at: np.ndarray, ids: np.ndarray, values: np.ndarray):
        super().__init__(cols, sizes, at, values)
        self.ids = ids

    @classmethod
    def of_cells(cls, sizes: np.ndarray, at: np.ndarray, values: np.ndarray, cols: int) -> SparseDictionary:
        table, ids = first_seen(values)
        return cls(cols, sizes, at, ids, table)

    @classmethod
    def read(cls, data: bytes) -> SparseDictionary:
        b = _Bytes(data)
        r, c, v, w = b.ints("IIIB")
        sizes = b.take("<u4", r).astype(np.int64)
        n = int(sizes.sum())
        at = b.take("<u4", n).astype(np.int64)
        ids = b.packed(w, n)
        return cls(c, sizes, at, ids, b.take("<f8", v).copy())

    def write(self) -> bytes:
        w = byte_width(len(self.stored))
        head = struct.pack("<IIIB", self.rows, self.cols, len(self.stored), w)
        return head + self.sizes.astype("<u4").tobytes() + self.at.astype("<u4").tobytes() + pack(self.ids, w) + self.stored.astype("<f8").tobytes()

    @property
    def cell_values(self) -> np.ndarray:
        return self.stored[self.ids]

    def total(self) -> float:
        return float(np.bincount(self.ids, minlength=len(self.stored)) @ self.stored)


class Logical(_Encoded):
    """`logicalfoc`: initial pairs and LZW codes."""

    def __init__(self, cols: int, pair_cols: np.ndarray, pair_values: np.ndarray, sizes: np.ndarray, codes: np.ndarray, nodes: int):
        self.rows, self.cols, self.pair_cols, self.pair_values = len(sizes), cols, pair_cols, pair_values
        self.sizes, self.codes, self.num_nodes = sizes, codes, nodes
        self._nodes: lzw.Nodes | None = None

    @property
    def nodes(self) -> lzw.Nodes:
        if self._nodes is None:
            self._nodes = lzw.Nodes(len(self.pair_cols), self.codes, self.sizes)
        return self._nodes

    @classmethod
    def of_cells(cls, sizes: np.ndarray, at: np.ndarray, values: np.ndarray, cols: int) -> Logical:
        table, which = first_seen(values)
        pairs, ids = first_seen(at * max(1, len(table)) + which)
        pair_cols, pair_values = np.divmod(pairs, max(1, len(table)))
        codes, counts, nodes = lzw.encode_ids(ids, sizes, len(pairs))
        return cls(cols, pair_cols, table[pair_values], counts, codes, nodes)

    @classmethod
    def read(cls, data: bytes) -> Logical:
        b = _Bytes(data)
        p, r, c, nodes = b.ints("iiii")
        at, values = b.take("<i4", p).astype(np.int64), b.take("<f8", p).copy()
        sizes = b.take("<i4", r).astype(np.int64)
        return cls(c, at, values, sizes, b.take("<i4", int(sizes.sum())).astype(np.int64), nodes)

    def write(self) -> bytes:
        head = struct.pack("<iiii", len(self.pair_cols), self.rows, self.cols, self.num_nodes)
        return head + self.pair_cols.astype("<i4").tobytes() + self.pair_values.astype("<f8").tobytes() + self.sizes.astype("<i4").tobytes() + self.codes.astype("<i4").tobytes()

    def _rows_of(self, per_pair: np.ndarray) -> np.ndarray:
        per_code = self.nodes.down(per_pair)[self.codes]
        out = np.zeros((self.rows, *per_pair.shape[1:]))
        np.add.at(out, self.nodes.row, per_code)
        return out

    def _pairs_of(self, per_row: np.ndarray) -> np.ndarray:
        held = np.zeros((len(self.nodes.parent), *per_row.shape[1:]))
        np.add.at(held, self.codes, per_row[self.nodes.row])
        return self.nodes.up(held)

    def times(self, b: np.ndarray) -> np.ndarray:
        return self._rows_of(self.pair_values[:, None] * b[self.pair_cols])

    def transposed_times(self, b: np.ndarray) -> np.ndarray:
        out = np.zeros((self.cols, b.shape[1]))
        np.add.at(out, self.pair_cols, self.pair_values[:, None] * self._pairs_of(b))
        return out

    def scale(self, s: int) -> None:
        self.pair_values = self.pair_values * s

    def square(self) -> None:
        self.pair_values = self.pair_values * self.pair_values

    def total(self) -> float:
        return float(self._pairs_of(np.ones(self.rows)) @ self.pair_values)

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = self.nodes.unfold()
        pair = np.array([p for r in rows for p in r], np.int64)
        return np.repeat(np.arange(self.rows), [len(r) for r in rows]), self.pair_cols[pair], self.pair_values[pair]


class Packed(Logical):
    """`toc`: as logicalfoc, with a dictionary of values and packed integers."""

    def write(self) -> bytes:
        values, ids = first_seen(self.pair_values)
        w_col, w_val, w_code = byte_width(self.cols), byte_width(len(values)), byte_width(int(self.codes.max(initial=0)))
        head = struct.pack("<BBBiiiii", w_code, w_col, w_val, len(self.pair_cols), len(values), self.rows, self.cols, self.num_nodes)
        return head + pack(self.pair_cols, w_col) + pack(ids, w_val) + values.astype("<f8").tobytes() + pack(self.sizes, w_col) + pack(self.codes, w_code) + b"\0"

    @classmethod
    def read(cls, data: bytes) -> Packed:
        b = _Bytes(data)
        w_code, w_col, w_val, p, v, r, c, nodes = b.ints("BBBiiiii")
        at, ids = b.packed(w_col, p), b.packed(w_val, p)
        values = b.take("<f8", v)[ids]
        sizes = b.packed(w_col, r)
        return cls(c, at, values, sizes, b.packed(w_code, int(sizes.sum())), nodes)


class Gzipped(Dense):
    def write(self) -> bytes:
        return zlib.compress(super().write(), 1, 31)

    @classmethod
    def read(cls, data: bytes) -> Gzipped:
        return super().read(zlib.decompress(data, 31))


class Snappied(Dense):
    """A raw snappy block; its first bytes tell the length, as a little-endian number of 7-bit digits."""

    def write(self) -> bytes:
        return pa.Codec("snappy").compress(super().write(), asbytes=True)

    @classmethod
    def read(cls, data: bytes) -> Snappied:
        size, at = 0, 0
        while True:
            size |= (data[at] & 127) << (7 * at)
            at += 1
            if data[at - 1] < 128:
                break
        return super().read(pa.Codec("snappy").decompress(data, size, asbytes=True))


FORMATS = {"mat": Dense, "csr": Sparse, "csrvi": SparseDictionary, "dvi": DenseDictionary, "logicalfoc": Logical, "toc": Packed, "gzip": Gzipped, "snappy": Snappied}


def codec(name: str):
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}; known: {', '.join(FORMATS)}")
    return FORMATS[name]


def encode(name: str, rows: list[list[tuple[int, float]]], cols: int) -> bytes:
    return codec(name).of(rows, cols).write()


def size_of(name: str, rows: int, cols: int, nnz: int, values: int, pairs: int = 0, codes: int = 0, max_code: int = 0) -> int:
    """Bytes of a batch by the formulas of its layout; values: distinct values of what the format stores."""
    w = byte_width
    return {
        "mat": 8 + 8 * rows * cols,
        "csr": 8 + 4 * rows + 12 * nnz,
        "csrvi": 13 + 4 * rows + 4 * nnz + w(values) * nnz + 8 * values,
        "dvi": 13 + w(values) * rows * cols + 8 * values,
        "logicalfoc": 16 + 12 * pairs + 4 * rows + 4 * codes,
        "toc": 23 + w(cols) * pairs + w(values) * pairs + 8 * values + w(cols) * rows + w(max_code) * codes + 1,
    }[name]
