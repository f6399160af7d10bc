import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import language_id, pitman_yor, subword
from loomgrid.llm.common import public_tokenizer

from .fixtures import empty, odd_texts, sentence, table, words

SYLLABLES = {"aa": "ka lo mi tu".split(), "bb": "sch ein ung tz".split(), "cc": "que eau oi ch".split()}


def prose(lang, rng, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_held_out_accuracy_and_cases(spark):
    rng = random.Random(1)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(300)]
    texts = [prose(x, rng) for x in langs]
    odd = odd_texts()
    docs = table(spark, texts + odd, langs + [None] * len(odd))
    got = {r.doc_id: r for r in language_id.identify_language(docs).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.98
    for i, t in enumerate(odd):
        r = got[300 + i]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= r.score <= 1
    assert language_id.identify_language(empty(spark)).count() == 0
    blank = language_id.identify_language(table(spark, ["some text", None], [None, None])).collect()
    assert [r.lang_pred for r in blank] == ["und", "und"]
    one = language_id.identify_language(table(spark, ["some text here", "more words"] * 5, ["xx"] * 10)).collect()
    assert {r.lang_pred for r in one} == {"xx"}


def test_prediction_sees_text_only(spark):
    rng = random.Random(2)
    langs = [x for x in SYLLABLES for _ in range(20)]
    docs = table(spark, [prose(x, rng) for x in langs], langs)
    model = language_id.fit_language_id(docs)
    other = table(spark, [(900 + i, "kalo mitu") for i in range(2)], ["bb", "cc"])
    got = language_id.predict_language(other, model, ["doc_id", "lang"]).collect()
    assert len({(r.lang_pred, r.score) for r in got}) == 1
    assert language_id.filter_language(docs).columns == docs.columns


@pytest.mark.parametrize("k", [2, 4, 7, 9, 30])
def test_codewords_are_apart(k):
    code = language_id.codewords(k)
    apart = (code.shape[1] - code @ code.T) / 2
    assert apart[~np.eye(k, dtype=bool)].min() >= (1 if k == 2 else code.shape[1] / 4)


def test_scores_of_the_plain_model(spark):
    """Base figures by brute force, probabilities that sum to one, and held-out texts scored above the base."""
    rng = random.Random(3)
    texts = [*odd_texts(), *[" ".join(f"w{rng.randint(0, 9) * rng.randint(0, 9)}" for _ in range(rng.randint(3, 80))) for _ in range(150)]]
    got = {r.doc_id: r for r in pitman_yor.pitman_yor_scores(table(spark, texts)).collect()}
    toks = [[*words(t), None] for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in train for w in toks[i])
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(toks):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(t), sum(count[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
    held = [got[i] for i in range(len(odd_texts()), len(texts)) if i not in train]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert pitman_yor.pitman_yor_scores(empty(spark)).count() == 0


def test_distribution_sums_to_one(spark):
    """The probabilities of all texts over the vocabulary and one unknown word, of whatever length, sum to one.

    With s, M and e the probabilities to begin with a word, to go on with one and to end, s e and s M e are scores of
    texts of one and two words; e follows from these as every word goes on or ends.
    """
    rng = random.Random(4)
    train = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 6))) for _ in range(80)]
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2][:80]
    held = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 7 == 2]
    kinds = [*"abcdef", "unseen"]
    asked = ["", *kinds, *(f"{x} {y}" for x in kinds for y in kinds)]
    got = {r.doc_id: r.score for r in pitman_yor.pitman_yor_scores(table(spark, [*zip(ids, train), *zip(held, asked)])).collect()}
    p = np.array([10 ** got[held[i]] for i in range(len(asked))])
    one, two = p[1:8], p[8:].reshape(7, 7)
    f = np.linalg.solve(np.eye(7) - two / one[:, None], np.ones(7))  # 1 / e
    assert (f > 1).all() and p[0] + (one * f).sum() == pytest.approx(1.0, rel=1e-5)


def seated(texts, d0, theta0, d1, theta1, sweeps, burn, rng):
    """The mean of predictive probabilities under a sampler that moves one customer at a time."""
    pairs = [(u, w) for t in texts for u, w in zip([0, *t], [*t, 1])]
    known = len({w for _, w in pairs})
    root, rest = {}, {}

    def prob(tables, w, d, theta, parent):
        c, t = sum(map(sum, tables.values())), sum(map(len, tables.values()))
        return (sum(tables.get(w, [])) - d * len(tables.get(w, [])) + (theta + d * t) * parent) / (theta + c)

    def sit(tables, w, d, theta, parent):
        mine = tables.setdefault(w, [])
        weights = [n - d for n in mine] + [(theta + d * sum(map(len, tables.values()))) * parent]
        k = rng.choices(range(len(weights)), weights)[0]
        if k < len(mine):
            mine[k] += 1
        else:
            mine.append(1)
        return k == len(weights) - 1

    def leave(tables, w):
        k = rng.choices(range(len(tables[w])), tables[w])[0]
        tables[w][k] -= 1
        if not tables[w][k]:
            del tables[w][k]
            return True
        return False

    def word(w):
        return prob(root, w, d0, theta0, 1 / (known + 1))

    mean = Counter()
    for sweep in range(sweeps):
        for u, w in pairs:
            if sweep and leave(rest[u], w):
                leave(root, w)
            if sit(rest.setdefault(u, {}), w, d1, theta1, word(w)):
                sit(root, w, d0, theta0, 1 / (known + 1))
        if sweep >= burn:
            for pair in set(pairs):
                mean[pair] += prob(rest[pair[0]], pair[1], d1, theta1, word(pair[1])) / (sweeps - burn)
    return [sum(math.log10(mean[x]) for x in zip([0, *t], [*t, 1])) for t in texts]


def test_scores_are_those_of_a_plain_sampler(spark, monkeypatch):
    rng = random.Random(6)
    texts = [[rng.randint(2, 4) * rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    want = seated(texts, *pitman_yor.WORDS, *pitman_yor.CONTEXTS, 400, 50, rng)
    monkeypatch.setattr(pitman_yor, "SAMPLES", 12)
    docs = table(spark, [" ".join(f"w{x}" for x in t) for t in texts])
    got = {r.doc_id: r.score for r in pitman_yor.pitman_yor_scores(docs, held=F.lit(False)).collect()}
    off = np.array([(got[i] - w) / (len(texts[i]) + 1) for i, w in enumerate(want)])
    assert abs(off.mean()) < 0.006 and np.abs(off).max() < 0.04


def stirling(c, d):
    """log of the generalised Stirling numbers of c customers, by t - 1."""
    out = np.zeros(1)
    for n in range(1, c):
        t = np.arange(1, n + 1)
        out = np.logaddexp(np.append(out + np.log(n - t * d), -np.inf), np.append(-np.inf, out))
    return out


@pytest.mark.parametrize("c, d, rate", [(3, 0.7, 0.9), (40, 0.85, 5.0), (64, 0.6, 0.2), (65, 0.6, 12.0), (300, 0.85, 40.0), (2000, 0.6, 3.0), (3000, 0.85, 0.4), (3000, 0.6, 200.0)])
def test_draws_follow_the_exact_conditional(c, d, rate):
    t = np.arange(1, c + 1)
    weight = stirling(c, d) + np.log(rate) * t
    weight = np.exp(weight - weight.max())
    weight /= weight.sum()
    mean = (weight * t).sum()
    spread = math.sqrt((weight * (t - mean) ** 2).sum())
    got = pitman_yor.draw_tables(np.full(20_000, c), np.full(20_000, rate), d, np.random.default_rng(1))
    assert abs(got.mean() - mean) < 4 * spread / math.sqrt(20_000) + 0.004 * mean and abs(got.std() - spread) < 0.05 * spread + 0.01
    share = np.bincount(got, minlength=c + 1)[1:] / 20_000
    assert c > 64 or np.abs(share - weight).max() < 0.015


def test_draws_of_any_size():
    rng = np.random.default_rng(2)
    c = np.array([0, 1, 2, 100, 10**5, 10**9])
    for rate in (1e-9, 0.5, 1e3, 1e8):
        t = pitman_yor.draw_tables(c, np.full(6, rate), 0.85, rng)
        assert t[0] == 0 and t[1] == 1 and (t[1:] >= 1).all() and (t <= c).all()


def test_null_ids_train(spark):
    got = pitman_yor.pitman_yor_scores(table(spark, [(None, "a b a"), (3, "a b")])).collect()
    assert {r.doc_id: (r.held_out, r.train_tokens) for r in got} == {None: (False, 7), 3: (False, 7)}


def test_pack_of_words():
    x = np.array([0, 1, (1 << 32) - 1, 123456789, 7, 7], np.uint64)
    assert pitman_yor._unpack(pitman_yor._open(pitman_yor._dense(pitman_yor._pack(x)))).tolist() == x.tolist()
    assert pitman_yor._open(pitman_yor._dense(b"")) == b""


def peak_of(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_chunks_and_shards():
    """What a chunk and a shard hold at most, a token and a pair: their tasks share an executor's memory with others."""
    n, words, none = 300_000, 40_000, np.zeros(0, np.uint64)
    rng = np.random.default_rng(2)
    asked, pairs = [], 0
    for chunk in range(4):
        toks = np.minimum(rng.integers(0, words, n), rng.integers(0, words, n))
        row = {"chunk": chunk, "words": pitman_yor._dense(pitman_yor._pack(np.arange(words))), "toks": pitman_yor._dense(pitman_yor._bytes(toks, "<u4")), "lens": [100] * (n // 100), "held": [False] * (n // 100)}
        x, peak = peak_of(lambda row=row: pitman_yor._Chunk(row, 1, none, 7))
        assert peak < 70 * n and x.pair_count.sum() == n
        u, m = np.unique(x.u, return_counts=True)
        asked.append((0, chunk, "ask_words", pitman_yor._pack(x.words), None, None, pitman_yor._bytes(x.word_count, "<u4")))
        asked.append((0, chunk, "ask_pairs", pitman_yor._pack(x.words[u]), pitman_yor._bytes(m, "<u4"), pitman_yor._pack(x.words[x.w]), pitman_yor._bytes(x.pair_count, "<u4")))
        pairs += len(x.u)
    t = pa.Table.from_batches([pitman_yor._rows(asked)])
    del x, asked
    out, peak = peak_of(lambda: pitman_yor._merge(1, none, 7)(t))
    assert peak < 88 * pairs
    got = {k: [pitman_yor._u32(pitman_yor._open(x)) for x, kind in zip(out.column("a").to_pylist(), out.column("kind").to_pylist()) if kind == k] for k in ("reply_words", "reply_pairs")}
    assert len(got["reply_words"]) == len(got["reply_pairs"]) == 4 and all(x.sum() >= n for x in got["reply_pairs"])


def long_texts():
    rng = random.Random(5)
    return ["a" * 700, "x" * 90 + " " * 70 + "y" * 80, "".join(rng.choice("abcdefgeinthe") for _ in range(2500)), "".join(rng.choice("the an in  ing\té中😀") for _ in range(2500)), "   lead" + " " * 33 + "  tail   ", "ing" * 400 + " " + "er" * 500, sentence(rng, 900), "中文字" * 200]


@pytest.mark.parametrize("chunk", [64, 257, 5000])
def test_subword_ids_are_the_library_s(spark, chunk):
    import sentencepiece

    texts = odd_texts() + long_texts() + long_texts()[:2]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizer("piece_bpe_32k.model"))
    docs = table(spark, texts)
    got = {r.doc_id: r for r in subword.subword_ids(docs, chunk=chunk).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == sp.encode(t or "") and got[i].n_ids == len(got[i].ids) and got[i].restored
    back = subword.decode_ids(subword.subword_ids(docs, chunk=chunk))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert subword.subword_ids(empty(spark)).count() == 0


def test_matrices_combine_associatively():
    lattice = subword.PieceLattice(public_tokenizer("piece_bpe_32k.model"))
    s = subword.BLANK + "thequickbrownfoxjumpsover" * 12
    at = lattice.cuts(s, 50)
    m = [lattice.transfer(s, p, q) for p, q in zip(at, at[1:])]
    assert len(m) > 3 and subword.product(subword.product(m[0], m[1]), m[2]) == subword.product(m[0], subword.product(m[1], m[2]))
    assert max(len({x for x, _ in a}) for a in m[1:]) > 1
    for n in range(1, len(m) + 1):  # trees of any number of leaves: one path, which steps through all matrices
        some = [*m[:-1][: n - 1], m[-1]] if n == len(m) else None
        if some:
            states = subword.combine(some)
            assert len(states) == n + 1 and all(pair in x for pair, x in zip(zip(states, states[1:]), some))
    rng = random.Random(1)
    for n in (1, 2, 3, 5, 8, 13):
        states = [(0, 0), *((rng.randint(1, 3), 0) for _ in range(n - 1)), (0, 0)]
        noise = [[((rng.randint(1, 3), 0), (rng.randint(1, 3), 0)) for _ in range(4)] for _ in range(n)]
        given = [sorted({*x, pair}) for x, pair in zip(noise, zip(states, states[1:]))]
        found = subword.combine(given)
        assert found[0] == found[-1] == (0, 0) and all(pair in x for pair, x in zip(zip(found, found[1:]), given))
    with pytest.raises(ValueError, match="no path"):
        subword.combine([[((0, 0), (1, 0))], [((2, 0), (0, 0))]])


def test_repeated_ids_keep_their_own_ids(spark):
    long = "the quick brown fox " * 40
    rows = [(1, "one"), (1, "two words"), (1, long), (1, long + "x"), (None, long)]
    got = sorted((str(r.doc_id), tuple(r.ids)) for r in subword.subword_ids(table(spark, rows), chunk=64).collect())
    lattice = subword.PieceLattice(public_tokenizer("piece_bpe_32k.model"))
    assert got == sorted((str(i), tuple(lattice.library.encode(t))) for i, t in rows)


def test_loss_weighted_decoding_and_ambiguity():
    """Each bit's loss is weighed by its margin; the nearest codeword wins, of equals the first, and a narrow lead is ambiguous."""
    rng = np.random.default_rng(8)
    code = language_id.codewords(9)
    trust = rng.uniform(0.1, 1, code.shape[1])
    model = language_id.EcocModel([str(i) for i in range(9)], code, np.zeros((code.shape[1], 1 << language_id.BITS), np.float32), np.zeros(code.shape[1]), trust)
    out = rng.normal(0, 1.5, (code.shape[1], 200))
    near, share = model.decode(out)
    for n in range(200):
        loss = [sum(t * math.exp(-min(4, max(-4, c * o))) for t, c, o in zip(trust, word, out[:, n])) for word in code]
        assert near[n] == min(range(9), key=lambda i: (loss[i], i))
        assert share[n] == pytest.approx(1 / sum(math.exp(-2 * (x - min(loss))) for x in loss))
    near, share = model.decode(np.zeros((code.shape[1], 1)))
    assert near[0] == 0 and share[0] == pytest.approx(1 / 9) and share[0] < language_id.CLEAR


def test_many_labels_are_bounded(spark, monkeypatch):
    """A dirty label column: the most frequent languages are learned, from a bounded sample."""
    monkeypatch.setattr(language_id, "MOST_LANGS", 3)
    monkeypatch.setattr(language_id, "MOST_ROWS", 30)
    rng = random.Random(3)
    langs = [x for x in SYLLABLES for _ in range(40)] + [f"junk{i}" for i in range(30)]
    docs = table(spark, [prose(x if x in SYLLABLES else rng.choice(list(SYLLABLES)), rng) for x in langs], langs)
    model = language_id.fit_language_id(docs)
    assert model.langs == sorted(SYLLABLES)
    again = language_id.fit_language_id(docs.repartition(5))
    assert np.array_equal(model.weights, again.weights)
