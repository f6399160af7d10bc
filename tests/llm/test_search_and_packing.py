import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import packing, posting_lists
from loomgrid.llm.common import public_tokenizer

from .fixtures import empty, odd_texts, sentence, table

NAME = public_tokenizer("word_bpe_49k.json")


def brute(rows, k, every):
    good = sorted({(i, tuple(map(float, v))) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)})
    out = {}
    for i, q in good:
        if i % every == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), j) for j, v in good if j != i)[:k]
            out[i] = near
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id, r["rank"]))
    return out


def check(spark, rows, every, recall):
    df = spark.createDataFrame([(i, v, "z", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, rep int")
    got, want = answers(posting_lists.nearest(df, F.col("vec_id") % every == 0)), brute(rows, 10, every)
    assert set(got) == {q for q, near in want.items() if near}
    hit = sum(len({j for _, j, _ in got[q]} & {j for _, j in want[q]}) for q in got)
    assert hit >= recall * sum(len(want[q]) for q in got)
    for q, near in got.items():
        assert [r for _, _, r in near] == list(range(1, len(near) + 1)) and len(near) == len(want[q])
        assert near == sorted(near) or [x[:2] for x in near] == sorted(x[:2] for x in near)
        vectors = {i: np.array(v, float) for i, v in rows if v is not None and len(v)}
        assert all(s == pytest.approx(np.sqrt(((vectors[j] - vectors[q]) ** 2).sum()), rel=1e-12) for s, j, _ in near)
    return got


def test_small_and_invalid_vectors(spark):
    bad = [(100, None), (200, []), (300, [0.0, 0.0]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (600, [None, 1.0])]
    rows = [(i * 10, [float(np.float32(i / 7)), 1.0]) for i in range(1, 8)] + [(1000, [1.0, 1.0]), (1000, [1.0, 1.0])]
    got = check(spark, rows + bad, 10, 1.0)
    assert not {100, 200, 300, 400, 500, 600} & (set(got) - {i for i, _ in rows})
    df = spark.createDataFrame(bad, "vec_id long, embedding array<float>")
    assert posting_lists.nearest(df, F.lit(True)).count() == 0


def test_ties_and_a_hot_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    got = check(spark, rows, 50, 1.0)
    assert [j for _, j, _ in got[1000]] == [0, *range(1001, 1010)] and [j for _, j, _ in got[0]] == list(range(1000, 1010))


def test_recall_over_many_lists(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16)) * 2
    rows = [(i, (centres[i % 40] + rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(4000)]
    check(spark, rows, 100, 0.9)


def test_remote_queries_get_all_answers(spark):
    """Four vectors far from the others, and one alone."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 8)) * 20
    rows = [(i, (centres[i % 20] + rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(1, 2001)]
    rows += [(10_000 * i, (np.full(8, 500.0) + rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(1, 5)]
    rows += [(50_000, np.full(8, -900.0, np.float32).tolist())]
    got = check(spark, rows, 10_000, 1.0)
    assert len(got) == 5 and all(len(x) == 10 for x in got.values())


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(3)
    c = rng.standard_normal((700, 12))
    graph, q = posting_lists.CentroidGraph(c), rng.standard_normal((50, 12))
    ids, dist = graph.search(q, 20)
    true = np.argsort(posting_lists._squares(q, c), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(ids, true)]) > 0.95 and (np.diff(dist, axis=1) >= 0).all()


def test_word_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer
    import pyarrow as pa

    rng = random.Random(4)
    odd = ["don't 'S can't", "ÀÉ straße. İstanbul éa ́x ﬁ Ǆ", "<|endoftext|> x", "中文字 test,", "a.b,c. ...", "9 a1 ²³ ٣", "Σίσυφος ΣΑΣ.", "µ. ª, ß.", "ŉ ĸ."]
    odd += ["".join(rng.choice("abcé É.,'0 \ńİ😀sS") for _ in range(rng.randint(0, 30))) for _ in range(500)] + odd_texts()
    ids, off = packing.WordEncoder(NAME).encode(pa.array(odd, pa.string()))
    t = Tokenizer.from_file(NAME)
    assert all(t.encode(s or "", add_special_tokens=False).ids + [0] == ids[a:b].tolist() for s, a, b in zip(odd, off, off[1:]))


def test_packing_law(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    rows = [(i, t) for i, t in enumerate([*odd_texts(), *[sentence(rng, rng.randint(1, 900)) for _ in range(60)]])] + [(3, "word")] * 5 + [(None, "no id")]
    got = packing.pack_documents(table(spark, rows)).toPandas()
    t = Tokenizer.from_file(NAME)
    want = []
    for d, x in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(-1 if d is None else d, k, k * 2048, len(ids[k * 2048 : (k + 1) * 2048]), zlib.crc32(ids[k * 2048 : (k + 1) * 2048].tobytes())) for k in range(-(-len(ids) // 2048))]
    mine = got.fillna(-1)[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).itertuples(index=False)
    assert sorted(map(tuple, mine)) == sorted(want)
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.offset == s.groupby("sequence_id").length.cumsum() - s.length).all() and s.groupby("sequence_id").length.sum().max() <= 2048
    assert s.sequence_id.nunique() <= -(-s.length.sum() // 2048) + 1
    assert packing.pack_documents(empty(spark)).count() == 0


def test_islands_meet_over_epochs(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([700, 600, 500, 430, 900, 1100])) for i in range(400)]
    pieces = spark.createDataFrame([(d, 0, 0, n, 0, d) for d, n in rows], "doc_id long, piece int, start long, length long, ids_crc32 long, spread long")
    got = packing.pack_islands(pieces, block=150, islands=3, epochs=3).toPandas()
    assert sorted(got.doc_id) == list(range(400)) and got.groupby("sequence_id").length.sum().max() <= 2048


def test_crossover_keeps_each_piece_once():
    g = packing.Groups(np.array([5, 4, 3, 3, 2, 2, 1, 7, 6, 5]), 10, 1)
    a, b = g.fresh(0.0), g.fresh(0.9)
    for child in (g.cross(a, b), g.mutate(a), g.evolve([a, b], 5, 6), g.evolve([a, b], 5, 6, 2)):
        assert sorted(i for x in child for i in x) == list(range(10)) and all(sum(g.sizes[i] for i in x) <= 10 for x in child)
    assert len(g.evolve([], 5, 10)) == 4


def test_evolution_beats_best_fit():
    """Triplets that fill bins exactly, where best fit in falling order misses the fewest bins, alone and among full bins."""
    for seed in range(4):
        rng = np.random.default_rng(seed)
        sizes = []
        for _ in range(20):
            a = int(rng.integers(380, 490))
            b = int(rng.integers(250, (1000 - a) // 2 + 1))
            sizes += [a, b, 1000 - a - b]
        g = packing.Groups(np.array(sizes), 1000, 3)
        plain, evolved = g.fresh(0.0), g.evolve([], packing.POPULATION, packing.GENERATIONS)
        assert g.bound == 20 and len(evolved) < len(plain)
        wide = packing.Groups(np.array(sizes + [1000] * 300), 1000, 3)
        evolved = wide.evolve([], packing.POPULATION, packing.GENERATIONS, 40)
        assert len(evolved) < len(wide.fresh(0.0)) and sorted(i for x in evolved for i in x) == list(range(360))


def test_packing_does_not_depend_on_partitions(spark):
    rng = random.Random(9)
    rows = [(i % 90, 0, 0, rng.randint(1, 2000), 7) for i in range(300)] + [(5, 0, 0, 300, 1)] * 60

    def shared(parts):
        pieces = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, piece int, start long, length long, ids_crc32 long, spread long").repartition(parts)
        got = packing.pack_islands(pieces.withColumn("spread", F.monotonically_increasing_id()), block=120)
        return sorted(sorted((r.doc_id, r.length) for r in x.near) for x in got.groupBy("sequence_id").agg(F.collect_list(F.struct("doc_id", "length")).alias("near")).collect())

    assert shared(1) == shared(5)


def test_blocks_share_what_they_leave_open(spark):
    """Of 50 blocks each leaves bins with room; together they need hardly more than the lower bound of all."""
    rng = random.Random(12)
    rows = [(i, 0, 0, rng.randint(1, 700), 7, i) for i in range(4000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, spread long")
    got = packing.pack_islands(pieces, block=80).toPandas()
    assert sorted(zip(got.doc_id, got.length)) == [(r[0], r[3]) for r in rows]
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.offset == s.groupby("sequence_id").length.cumsum() - s.length).all() and s.groupby("sequence_id").length.sum().max() <= 2048
    assert s.sequence_id.nunique() <= -(-s.length.sum() // 2048) + 1


def test_pieces_that_leave_room_anyway(spark):
    """No two fit together: as many sequences as pieces, and an end."""
    pieces = spark.createDataFrame([(i, 0, 0, 1100 + i % 7, 7, i) for i in range(300)], "doc_id long, piece int, start long, length long, ids_crc32 long, spread long")
    got = packing.pack_islands(pieces, block=20).toPandas()
    assert got.sequence_id.nunique() == 300 and sorted(got.doc_id) == list(range(300))


def test_clustered_queries_read_few_lists():
    """20,000 clustered rows: recall by brute force, and the share of lists that a query reads."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((150, 24)) * 3
    x = centres[rng.integers(0, 150, 20_000)] + rng.standard_normal((20_000, 24))
    lists = len(x) // posting_lists.LIST
    sample = x[rng.permutation(len(x))[: posting_lists.SAMPLE * lists]]
    c = posting_lists.balanced_centroids(sample, lists)
    graph = posting_lists.CentroidGraph(c, float(np.median(posting_lists._squares(sample, c).min(1) ** 0.5)))
    graph.fit_pruning(sample, 10)
    q = x[:200]
    row, at = graph.probes(q)
    entered, where = graph.entries(x)
    hits = 0
    for i in range(len(q)):
        d = ((x - q[i]) ** 2).sum(1)
        d[i] = np.inf
        near = set(np.argsort(d, kind="stable")[:10].tolist())
        hits += len(near & set(entered[np.isin(where, at[row == i])].tolist()))
    assert hits / 2000 > 0.95 and len(row) / len(q) / lists < 0.15
