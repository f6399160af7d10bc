import random

import numpy as np
import pytest

from loomgrid.llm import near_duplicates as near
from loomgrid.llm.common import text_bytes, word_hashes
from loomgrid.llm.components import connected_components

from .fixtures import empty, odd_texts, sentence, table, words


def sets(rows, k):
    out = []
    for d, t in rows:
        w = words(t)
        out.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    return out


def brute(rows, k, percent=80):
    s = sets(rows, k)
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            a, b = s[i][1], s[j][1]
            if (s[i][0] == s[j][0]) or (a and b and 100 * len(a & b) >= percent * len(a | b)):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(s):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return {(d, len(x), least[find(i)], d == least[find(i)]) for i, (d, x) in enumerate(s)}


def families(seed, groups, size, edit, length):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = sentence(rng, length).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edit)):
                w[rng.randrange(len(w))] = sentence(rng, 1) + "q"
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


def result(df):
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("k", [2, 5])
def test_odd_rows(spark, k):
    rows = list(enumerate(odd_texts()))
    assert result(near.near_duplicates(table(spark, rows), k)) == brute(rows, k)


def test_families_with_links_at_the_threshold(spark):
    texts = families(1, 6, 14, 14, 120)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    assert result(near.near_duplicates(table(spark, rows), 2)) == brute(rows, 2)


def test_split_regions(spark, monkeypatch):
    """Regions far over their size, so that parts, leaders and asking all take part; workers see the module as shipped."""
    texts = families(2, 1, 260, 10, 100) + families(3, 2, 20, 12, 100)
    rows = list(enumerate(texts))
    monkeypatch.setattr(near, "REGION", 40)
    assert result(near.near_duplicates(table(spark, rows), 2)) == brute(rows, 2)


def test_repeated_ids_and_null_ids(spark):
    a, b = sentence(random.Random(1), 60), sentence(random.Random(2), 60)
    rows = [(5, a), (5, b), (9, b), (2, a), (7, None), (7, None)]
    assert result(near.near_duplicates(table(spark, rows), 2)) == brute(rows, 2)
    got = near.near_duplicates(table(spark, [(None, a), (3, a)]), 2).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (3, 3, True)}
    assert near.near_duplicates(empty(spark), 2).count() == 0


def test_keep_first_keeps_columns_and_one_of_each(spark):
    docs = table(spark, [*odd_texts(), (1, "")])
    out = near.keep_first(docs, k=5)
    assert out.columns == docs.columns
    twice = near.keep_first(table(spark, [(1, "one text here"), (1, "another text here"), (1, "one text here"), (2, "a third text")]))
    assert sorted((r.doc_id, r.text) for r in twice.collect()) == [(1, "another text here"), (1, "one text here"), (2, "a third text")]
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in near.near_duplicates(docs, 5).where("kept").select("doc_id").distinct().collect())


def test_word_hashes_over_blocks(monkeypatch):
    import pyarrow as pa

    import loomgrid.llm.common as common

    texts = odd_texts()
    whole = word_hashes(*text_bytes(pa.array(texts, pa.string())))
    monkeypatch.setattr(common, "BLOCK_BYTES", 1000)
    parts = word_hashes(*text_bytes(pa.array(texts, pa.string())))
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    assert np.diff(whole[1]).tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert len({(a, b) for a, b in zip(flat, whole[0].tolist())}) == len(set(flat)) == len(set(whole[0].tolist()))


def sorted_labels(seed, n):
    """Labels that share prefixes of all lengths, some equal."""
    rng = np.random.default_rng(seed)
    rows = [rng.integers(0, 256, 1 + near.LABEL) for _ in range(n // 4)]
    for _ in range(n - len(rows)):
        base = rows[rng.integers(0, max(1, n // 8))].copy()
        base[rng.integers(0, 2 + near.LABEL) :] = rng.integers(0, 256)
        rows.append(base)
    rows = sorted(x.astype(np.uint8).tobytes() for x in rows)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(n, -1)


@pytest.mark.parametrize("most", [1, 3, 20, 1000])
def test_regions_take_the_fewest_levels(most):
    label = sorted_labels(most, 400)
    group, deeper = near.regions(label, 4, most)
    depth_of = lambda i, j: next((d for d in range(label.shape[1]) if label[i, d] != label[j, d]), label.shape[1])
    assert np.bincount(group).max() <= most and (np.diff(group) >= 0).all()
    for i in range(1, len(label)):
        same = [j for j in range(len(label)) if depth_of(i, j) >= 5]
        assert deeper[i] == (len(same) > most)
        if not deeper[i]:
            assert set(np.flatnonzero(group == group[i])) == set(same)
    for g in range(group[-1] + 1):  # one level less would be too many
        at = np.flatnonzero(group == g)
        depth = depth_of(at[0], at[-1])
        if deeper[at[0]] and depth < label.shape[1]:
            out = [j for j in range(len(label)) if depth_of(at[0], j) >= max(5, depth)]
            assert set(at) <= set(out)


def test_parts_hold_whole_regions(monkeypatch):
    import pyarrow as pa

    label = sorted_labels(7, 300)
    own = near._at_depth(label)
    for held, size in ((1, 7), (40, 13), (1000, 50)):
        monkeypatch.setattr(near, "HELD", held)
        made = [pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in label[i : i + size]], pa.binary()), pa.array(np.arange(len(label))[i : i + size]), pa.array(np.ones(len(label[i : i + size]), np.int64))], ["label", "rep", "n"]) for i in range(0, len(label), size)]
        got = list(near._parts(iter(made)))
        assert np.concatenate([x[1] for x in got]).tolist() == list(range(len(label)))
        whole = [own[x[1]] for x in got]
        for (a, x), (b, y) in zip(zip(whole, got), zip(whole[1:], got[1:])):
            assert set(a.tolist()).isdisjoint(b.tolist()) or (x[4] and y[3])
        assert got[0][3] and got[-1][4]


def test_cut_and_crowded_regions(spark, monkeypatch):
    """Tasks that hold few rows cut most regions; leaders meet again and members ask."""
    texts = families(4, 2, 90, 8, 80) + families(5, 5, 6, 10, 90)
    monkeypatch.setattr(near, "HELD", 30)
    monkeypatch.setattr(near, "REGION", 12)
    monkeypatch.setattr(near, "BLOCK", 25)
    monkeypatch.setattr(near, "ASKERS", 10)
    rows = list(enumerate(texts))
    assert result(near.near_duplicates(table(spark, rows), 2)) == brute(rows, 2)


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (11, 9), (4, 4), *[(100, 100 + i) for i in range(1, 40)], *[(200 + i, 201 + i) for i in range(30)]]
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 9), (10, 9), (11, 9), *[(100 + i, 100) for i in range(40)], *[(200 + i, 200) for i in range(31)]}
