"""Encodings: goldens, exact sizes, round trips, and equal operators in all formats."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrid.operators import codecs, lzw
from loomgrid.operators.codecs import FORMATS, codec, encode, size_of

CSV = [[(0, 1.0), (1, 2.0), (3, 1.0)], [(0, 2.0), (1, 3.0), (2, 1.0), (3, 2.0)], [(0, 3.0), (1, 3.0), (3, 5.0)]]
LIBSVM = [[(1, 1.0), (2, 2.0)], [(2, 2.0), (3, 3.0)], [(3, 3.0), (4, 4.0)]]
SKIN = [[(c, float(v)) for c, v in enumerate(r)] for r in ((74, 85, 123, 1), (73, 84, 122, 1), (72, 83, 121, 1), (70, 81, 119, 1))]
OVERLAP = [[(0, 1.1), (1, 2.0), (2, 3.0), (3, 1.4)], [(0, 1.1), (1, 2.0), (2, 3.0)], [(2, 3.0), (3, 1.4)], [(0, 1.1), (1, 2.0)]]
EMPTY_ROW = [[(0, 1.0), (1, 2.0), (2, 3.0)], [], [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)], [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)]]


@pytest.mark.parametrize(
    ("rows", "cols", "sizes"),
    [
        (CSV, 4, {"mat": 104, "csr": 140, "csrvi": 107, "dvi": 65, "logicalfoc": 176, "toc": 87}),
        (LIBSVM, 5, {"mat": 128, "csr": 92, "csrvi": 87, "dvi": 68, "logicalfoc": 100, "toc": 73}),
        (SKIN, 4, {"mat": 136, "csr": 216, "csrvi": 213, "dvi": 133, "logicalfoc": 252, "toc": 174}),
        (OVERLAP, 4, {"mat": 136, "csr": 156, "csrvi": 116, "dvi": 69, "logicalfoc": 112, "toc": 76}),
    ],
)
def test_exact_sizes(rows, cols, sizes):
    assert {k: len(encode(k, rows, cols)) for k in sizes} == sizes


def test_lzw_goldens():
    pairs, codes, nodes = lzw.encode(CSV)
    assert pairs == [(0, 1), (1, 2), (3, 1), (0, 2), (1, 3), (2, 1), (3, 2), (0, 3), (3, 5)]
    assert (codes, nodes) == ([[0, 1, 2], [3, 4, 5, 6], [7, 4, 8]], 16)
    assert lzw.encode(LIBSVM)[1:] == ([[0, 1], [1, 2], [2, 3]], 7)
    assert lzw.encode(OVERLAP)[1:] == ([[0, 1, 2, 3], [4, 2], [6], [4]], 8)
    assert lzw.encode(EMPTY_ROW)[1:] == ([[0, 1, 2], [], [4, 2, 3], [6, 3]], 9)


@pytest.mark.parametrize("name", FORMATS)
def test_products_of_goldens(name):
    v = np.array([[1.0], [10.0], [100.0], [1000.0]])
    got = codec(name).read(encode(name, OVERLAP, 4)).times(v)[:, 0]
    assert got == pytest.approx([1721.1, 321.1, 1700.0, 21.1])
    assert codec(name).read(encode(name, EMPTY_ROW, 4)).times(v)[:, 0].tolist() == [321, 0, 4321, 4321]


batches = st.integers(1, 6).flatmap(
    lambda cols: st.tuples(
        st.just(cols),
        st.lists(st.dictionaries(st.integers(0, cols - 1), st.sampled_from([1.0, 2.0, -3.5, 0.25, 7.0]), max_size=cols).map(lambda d: sorted(d.items())), max_size=8),
    )
)


@settings(max_examples=60, deadline=None)
@given(batches)
def test_every_format_agrees(case):
    cols, rows = case
    x = codecs.Dense.of(rows, cols).x
    b, left = np.arange(cols * 2.0).reshape(cols, 2) - 3, np.arange(len(rows) * 2.0).reshape(len(rows), 2) + 1
    for name, cls in FORMATS.items():
        data = encode(name, rows, cols)
        m = cls.read(data)
        assert m.write() == data and m.size() == len(data)
        assert m == cls.read(data) and (not rows or not cols or m != cls.of([*rows, [(0, 9.5)]], cols))
        assert np.allclose(m.times_vector(b[:, 0]), x @ b[:, 0]) and np.allclose(m.vector_times(left[:, 1]), left[:, 1] @ x)
        assert np.allclose(m.times(b), x @ b) and np.allclose(m.transposed_times(left), x.T @ left)
        assert m.total() == pytest.approx(x.sum())
        r, c, v = m.cells()
        assert sorted(zip(r.tolist(), c.tolist(), v.tolist())) == [(i, j, x[i, j]) for i, j in np.argwhere(x != 0).tolist()]
        m.scale(3)
        m.square()
        assert np.allclose(m.times(b), (9 * x * x) @ b)


@settings(max_examples=60, deadline=None)
@given(batches)
def test_lzw_round_trip_and_sizes(case):
    cols, rows = case
    pairs, codes, nodes = lzw.encode(rows)
    assert lzw.decode(pairs, codes) == rows
    flat = [c for r in codes for c in r]
    nnz, values = sum(map(len, rows)), len({v for r in rows for _, v in r})
    dense = len(set(codecs.Dense.of(rows, cols).x.reshape(-1).tolist()))
    known = {"mat": 0, "csr": 0, "csrvi": values, "dvi": dense, "logicalfoc": 0, "toc": len({v for _, v in pairs})}
    for name, n in known.items():
        assert len(encode(name, rows, cols)) == size_of(name, len(rows), cols, nnz, n, len(pairs), len(flat), max(flat, default=0))


@pytest.mark.parametrize(("n", "width"), [(255, 1), (256, 2), (65535, 2), (65536, 3), (1 << 24, 4)])
def test_widths(n, width):
    assert codecs.byte_width(n) == width
    values = np.array([0, min(n, (1 << 32) - 1) - 1])
    assert codecs.unpack(codecs.pack(values, width), width).tolist() == values.tolist()


def test_256_values_need_two_bytes():
    for count, width in ((255, 1), (256, 2)):
        rows = [[(0, float(i + 1))] for i in range(count)]
        assert len(encode("csrvi", rows, 1)) == 13 + 4 * count + 4 * count + width * count + 8 * count


def test_unknown_format():
    with pytest.raises(ValueError, match="unknown format"):
        codec("zip")
