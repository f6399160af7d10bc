"""Language-model scores by a hierarchical Pitman-Yor model.

Every context (the word before; a start mark for the first) has a restaurant, and all of them share their parent,
the restaurant of words without context, whose base is uniform over the V known tokens and one unknown. A dish's
customers in the parent are its tables in the children. Seating is sampled by Gibbs sweeps over all restaurants at
once, made independent by two auxiliary variables. A restaurant of T tables draws a rate from a gamma distribution of
shape strength / discount + T; given it, the tables of its dishes are independent, those of a dish of c customers and
parent probability p being t with a probability in proportion to S(c, t) (discount x rate x p)**t, S the generalised
Stirling numbers. And the parent draws its own measure, a Dirichlet draw of what its tables hold, so that given it
the children are independent; what is left for new tables is spread by its mean. So dishes and contexts of a sweep are
drawn side by side, and each draw is from its exact conditional: up to EXACT customers from the table of S, beyond
that from the table of a model of fewer customers, scaled, which moves their mean by a hundredth at most. After BURN sweeps, SAMPLES are kept; a token's
probability is the mean of its predictive probabilities under them. Discounts and strengths are parameters.

How it is spread: words are numbered by shards from their hashes, and texts become chunks of word numbers. Contexts, with their dishes, and words belong
to shards by hash; the dishes of contexts that hold a large share of all tokens are dealt by the pair. Chunks ask
shards for the pairs they hold, shards tell each other customers and parent probabilities, and shards answer
chunks. All messages are packed arrays; the driver sees a few numbers a shard and the contexts of a large share. Words
are told apart by 64-bit hashes: among ten million words two collide with a probability of 3e-6.

Cases: null and empty texts have the end token alone. Without training documents, V and N are 0 and every token
has the base probability of the unknown. Equal rows are scored apart and alike. A null doc_id has no crc32: it is not
held out, and trains. An empty table gives an empty result; other columns are ignored. One document's word hashes are held in memory at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batches, discard, materialise, mix64, release_memory, text_bytes, word_hashes
from .language_id import crc_mod

#: Discount and strength of the shared restaurant and of the contexts'.
WORDS, CONTEXTS = (0.6, 1.0), (0.85, 1.0)
BURN, SAMPLES = 3, 4
#: Customers up to which conditionals are read from a table of Stirling numbers.
EXACT = 64
#: Points at which a conditional beyond that is computed; of ranges that are wider, points between are drawn evenly.
POINTS = 96
#: Tokens of a chunk and of a shard, about.
CHUNK_TOKENS, SHARD_TOKENS = 1_500_000, 2_200_000
END, START = U64(0x0E4D), U64(0x57A7)

_MESSAGE = "to long, frm long, kind string, a binary, b binary, c binary, d binary"
_CHUNK = "chunk long, doc_id array<long>, held array<boolean>, lens array<int>, words binary, toks binary"


def _pack(x: np.ndarray) -> bytes:
    """Word numbers, in ascending runs, as steps."""
    return np.diff(x.astype("<u4"), prepend=np.uint32(0)).astype("<u4").tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, "<u4"), dtype=np.uint32).astype(U64)


def _u32(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", "<u4").astype(np.int64)


def _f32(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", "<f4").astype(np.float64)


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def _dense(blob: bytes | None) -> bytes | None:
    """A part of a message as it is sent: its length and its compressed bytes, those of equal place in 32-bit numbers together."""
    if blob is None:
        return None
    planes = np.frombuffer(blob, np.uint8).reshape(-1, 4).T.tobytes()
    return len(blob).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _open(blob: bytes | pa.Buffer | None) -> bytes | None:
    if blob is None:
        return None
    blob = memoryview(blob)
    planes = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd")
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.tobytes()


def _opened(row: dict) -> dict:
    return row | {c: _open(row[c]) for c in "abcd" if c in row}


def _rows(rows: Iterable[tuple]) -> pa.RecordBatch:
    """Messages (to, frm, kind, a, b, c, d); missing parts are null. Of a generator's, only what is sent is held."""
    full = [(*r[:3], *map(_dense, r[3:]), *[None] * (7 - len(r))) for r in rows]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], t) for i, t in enumerate(kinds)], ["to", "frm", "kind", "a", "b", "c", "d"])


def _mail(t: pa.Table) -> dict[str, list[dict]]:
    """Messages by kind, in the order of their senders."""
    out: dict[str, list[dict]] = {}
    frm, kind = t.column("frm").to_numpy(), t.column("kind").to_pylist()
    for i in np.argsort(frm, kind="stable").tolist():
        out.setdefault(kind[i], []).append({"frm": int(frm[i])} | {c: _open(t.column(c)[i].as_buffer()) for c in "abcd"})
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and which of them each is, in 32 bits."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    group = np.cumsum(new, dtype=np.uint32)
    group -= 1
    at = np.empty(len(x), np.uint32)
    at[order] = group
    return x[new], at


def _sparing(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f of a shard; the memory it took goes back."""

    def run(t: pa.Table) -> pa.Table:
        out = f(t)
        release_memory()
        return out

    return run


def _stirling(d: float) -> list[np.ndarray]:
    """log of the generalised Stirling numbers: for c customers, by t - 1."""
    out = [np.zeros(0), np.zeros(1)]
    for c in range(1, EXACT):
        old = out[-1]
        t = np.arange(1, c + 1)
        stay = np.append(old + np.log(c - t * d), -np.inf)
        out.append(np.logaddexp(stay, np.append(-np.inf, old)))
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of numbers from 1 on, by Stirling's series seven steps up."""
    z = x + 7
    low = sum(np.log(x + i) for i in range(7))
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) - low


#: Customers whose Stirling numbers are kept as a model of the more numerous: from EXACT on, four in each doubling.
MODELS = [round(EXACT * 2 ** (k / 4)) for k in range(21)]
_SUMS: dict[float, list[np.ndarray]] = {}


def _log_sums(d: float) -> list[np.ndarray]:
    """For each c of MODELS, by t from 0: log of P(c, t) / t, up to a constant, where S(c, t) = c! / (t! d**t) P(c, t) and P is
    the probability that t table sizes, drawn alone, add up to c."""
    if d not in _SUMS:
        out, row = [], np.zeros(1)
        for c in range(1, MODELS[-1] + 1):
            if c in MODELS:
                t = np.arange(1, c + 1.0)
                h = row + _log_gamma(t + 1) + t * np.log(d) - np.log(t)
                out.append(np.concatenate([[2 * h[0] - h[1]], h]))
            t = np.arange(1, c + 1)
            row = np.logaddexp(np.append(row + np.log(c - t * d), -np.inf), np.append(-np.inf, row))
        _SUMS[d] = out
    return _SUMS[d]


def _log_weights(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) up to a constant for each row of t, for many customers c. Table sizes have a tail of index d, so P(c, t)
    depends on t / c**d alone as c grows, and a model of fewer customers tells it."""
    which = np.searchsorted(MODELS, c, side="right") - 1
    out = np.log(t) - _log_gamma(t + 1.0) - t * np.log(d)
    for k in np.unique(which):
        at = which == k
        out[at] += np.interp(t[at] / ((c[at] / MODELS[k]) ** d)[:, None], np.arange(MODELS[k] + 1.0), _log_sums(d)[k])
    return out


def draw_tables(c: np.ndarray, rate: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """For dishes of c customers, tables t with a probability in proportion to S(c, t) rate**t."""
    t = np.minimum(c, 1).astype(np.int64)
    table = _stirling(d)
    log_rate = np.log(rate)
    for n in np.unique(c[(c >= 2) & (c <= EXACT)]):
        at = np.flatnonzero(c == n)
        for i in range(0, len(at), 1 << 13):
            some = at[i : i + (1 << 13)]
            w = table[n] + log_rate[some][:, None] * np.arange(1, n + 1)
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            t[some] = 1 + (w < rng.random(len(some))[:, None] * w[:, -1:]).sum(axis=1)
    many = np.flatnonzero(c > EXACT)
    for i in range(0, len(many), 1 << 12):
        some = many[i : i + (1 << 12)]
        t[some] = _draw_many(c[some].astype(float), log_rate[some], d, rng)
    return t


def _draw_many(c: np.ndarray, log_rate: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """The same for many customers: points over the whole range find where the weight lies, points there give the draw."""
    weight = lambda t: _log_weights(c, t, d) + log_rate[:, None] * t
    steps = np.linspace(0, 1, POINTS)
    low, high = np.ones(len(c)), c.copy()
    for geometric in (True, False):
        t = low[:, None] * (high / low)[:, None] ** steps if geometric else low[:, None] + (high - low)[:, None] * steps
        w = weight(t)
        here = w > w.max(axis=1, keepdims=True) - 30  # log-concave: one run
        first, last = here.argmax(axis=1), POINTS - 1 - here[:, ::-1].argmax(axis=1)
        row = np.arange(len(c))
        low, high = np.floor(t[row, np.maximum(first - 1, 0)]), np.ceil(t[row, np.minimum(last + 1, POINTS - 1)])
        low, high = np.maximum(low, 1), np.minimum(high, c)
    step = np.maximum(1, np.ceil((high - low + 1) / POINTS))
    t = np.minimum(low[:, None] + step[:, None] * np.arange(POINTS), c[:, None])
    w = weight(t)
    w[low[:, None] + step[:, None] * np.arange(POINTS) > high[:, None]] = -np.inf
    w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
    k = (w < rng.random(len(c))[:, None] * w[:, -1:]).sum(axis=1)
    return np.clip(t[np.arange(len(c)), k] + np.floor(rng.random(len(c)) * step) - np.floor((step - 1) / 2 + rng.random(len(c))), 1, c).astype(np.int64)


def draw_rates(tables: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """discount x the auxiliary rate of restaurants of so many tables."""
    return d * rng.gamma(theta / d + tables)


def _chunks(docs: DataFrame) -> DataFrame:
    """Chunks of documents: sorted hashes of their words, and which of them the tokens are."""

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, lens, toks, count = [], [], [], [], 0
        number = TaskContext.get().partitionId() << 32

        def hand_on() -> pa.RecordBatch:
            nonlocal number, count
            every = np.concatenate([*toks, [END, START]])
            toks.clear()
            words, at = _distinct(every)
            row = [[number], [ids[:]], [held[:]], [lens[:]], [words.tobytes()], [_dense(_bytes(at[:-2], "<u4"))]]
            number, count = number + 1, 0
            for x in (ids, held, lens):
                x.clear()
            del every, words, at
            release_memory()
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], ["chunk", "doc_id", "held", "lens", "words", "toks"])

        for b in batches(it):
            h, first = word_hashes(*text_bytes(b.column("text")))
            h |= U64(1 << 20)  # no word is END or START
            with_end = np.insert(h, first[1:], END)
            n = np.diff(first) + 1
            ids += b.column("doc_id").to_pylist()
            held += b.column("held").to_pylist()
            lens += n.tolist()
            toks.append(with_end)
            count += len(with_end)
            if count >= CHUNK_TOKENS:
                yield hand_on()
        if ids:
            yield hand_on()

    return docs.mapInArrow(make, _CHUNK)


def _hashes(chunks: DataFrame, shards: int) -> DataFrame:
    """The hashes of chunks' words, to their shards."""

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("words").to_pylist()):
                h = np.frombuffer(blob, "<u8")
                yield _rows([(r, chunk, "hashes", h[x].tobytes()) for r, x in enumerate(_deal((h % U64(shards)).astype(np.int64), shards))])

    return chunks.select("chunk", "words").mapInArrow(send, _MESSAGE)


def _number(t: pa.Table) -> pa.Table:
    """Shard: number its words; tells chunks, and the driver how many there are and which is the start mark."""
    r, mail = t.column("to")[0].as_py(), _mail(t)["hashes"]
    own = [np.frombuffer(m["a"], "<u8") for m in mail]
    words, at = _distinct(np.concatenate(own))
    start = np.flatnonzero(words == START)
    out = [(m["frm"], r, "numbers", _bytes(x, "<u4")) for m, x in zip(mail, np.split(at, np.cumsum([len(x) for x in own])[:-1]))]
    return pa.Table.from_batches([_rows([*out, (r, r, "size", np.array([len(words), start[0] if len(start) else -1], "<i8").tobytes())])])


def _numbered(chunks: DataFrame, numbers: DataFrame, shards: int, before: np.ndarray) -> DataFrame:
    """Chunks with numbers, ascending, instead of hashes. before: the number of words of the shards before each."""

    def renumber(key: object, own: pa.Table, mail: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        h = np.frombuffer(row["words"], "<u8")
        number = np.zeros(len(h), np.int64)
        cut = _deal((h % U64(shards)).astype(np.int64), shards)
        for m in map(_opened, mail.to_pylist()):
            number[cut[m["frm"]]] = before[m["frm"]] + _u32(m["a"])
        order = np.argsort(number)
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        made = {"words": _dense(_pack(number[order])), "toks": _dense(_bytes(rank[_u32(_open(row["toks"]))], "<u4"))}
        return pa.table([pa.array([made[c]], pa.binary()) if c in made else own.column(c) for c in own.column_names], names=own.column_names)

    return chunks.groupBy("chunk").cogroup(numbers.withColumnRenamed("to", "chunk").groupBy("chunk")).applyInArrow(renumber, _CHUNK)


def _heavy(chunks: DataFrame, least: int) -> DataFrame:
    """Words and their counts in chunks of which they are a share of 1 / least or more."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for blob, toks in zip(b.column("words").to_pylist(), b.column("toks").to_pylist()):
                words, at = _unpack(_open(blob)), _u32(_open(toks))
                n = np.bincount(at, minlength=len(words))
                big = np.flatnonzero(n * least >= len(at))
                yield pa.RecordBatch.from_arrays([pa.array(words[big].astype(np.int64)), pa.array(n[big].astype(np.int64))], ["word", "n"])

    return chunks.select("words", "toks").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Chunk:
    """A chunk's tokens and its distinct pairs of a word and the word before."""

    def __init__(self, row: dict, shards: int, hot: np.ndarray, start: int):
        self.words = _unpack(_open(row["words"]))
        self.toks = np.frombuffer(_open(row["toks"]), "<u4")
        self.lens, self.held = np.array(row["lens"], np.int64), np.array(row["held"], bool)
        self.first = np.cumsum(self.lens) - self.lens
        key = np.empty(len(self.toks), np.int64)
        key[1:] = self.toks[:-1]
        key[self.first] = np.searchsorted(self.words, U64(start))
        key <<= 32
        key |= self.toks
        key, self.pair = _distinct(key)
        self.u, self.w = (key >> 32).astype(np.uint32), key.astype(np.uint32)
        train = np.repeat(~self.held, self.lens)
        self.pair_count = np.bincount(self.pair[train], minlength=len(key)).astype(np.uint32)
        del key
        self.word_count = np.bincount(self.toks[train], minlength=len(self.words))
        self.word_count[np.searchsorted(self.words, U64(start))] = (~self.held).sum()
        word_shard = (self.words % U64(shards)).astype(np.int64)
        pair_shard = _pair_shard(self.words[self.u], self.words[self.w], shards, hot)
        self.word_cut, self.pair_cut = _deal(word_shard, shards), _deal(pair_shard, shards)


def _pair_shard(u: np.ndarray, w: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    out = (u % U64(shards)).astype(np.int64)
    is_hot = np.isin(u, hot)
    out[is_hot] = (mix64(u[is_hot] ^ (w[is_hot] << U64(11))) % U64(shards)).astype(np.int64)
    return out


def _deal(shard: np.ndarray, shards: int) -> list[np.ndarray]:
    """For each shard the rows that belong to it, in order."""
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))


def _ask(chunks: DataFrame, shards: int, hot: np.ndarray, start: int) -> DataFrame:
    """What chunks ask of shards: words (a, counts d), and pairs (contexts a, run lengths b, words c, counts d)."""

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for row in b.to_pylist():
                x = _Chunk(row, shards, hot, start)
                for r in range(shards):
                    w, p = x.word_cut[r], x.pair_cut[r]
                    u, n = np.unique(x.u[p], return_counts=True)
                    yield _rows(
                        [
                            (r, row["chunk"], "ask_words", _pack(x.words[w]), None, None, _bytes(x.word_count[w], "<u4")),
                            (r, row["chunk"], "ask_pairs", _pack(x.words[u]), _bytes(n, "<u4"), _pack(x.words[x.w[p]]), _bytes(x.pair_count[p], "<u4")),
                        ]
                    )
                del x
                release_memory()

    return chunks.mapInArrow(ask, _MESSAGE)


def _merged_pairs(asked: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """All pairs that chunks ask for: contexts, words, counts, and each chunk's rows among them."""
    key = np.concatenate([(np.repeat(_unpack(r["a"]), _u32(r["b"])) << U64(32)) | _unpack(r["c"]) for r in asked])
    n = np.concatenate([np.frombuffer(r["d"], "<u4") for r in asked])
    key, back = _distinct(key)
    return key >> U64(32), key & U64(0xFFFFFFFF), np.bincount(back, n, len(key)).astype(np.int64), np.split(back, np.cumsum([len(r["d"]) // 4 for r in asked])[:-1])


def _ascending(number: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The numbers of some rows, which ascend, as steps; small steps make dense tables."""
    return np.diff(number[rows[which]], prepend=0)


def _merge(shards: int, hot: np.ndarray, start: int):
    """Shard: add up what chunks counted; one table a pair. Tells the words' shards the customers, keeps pairs of two or
    more, and, for each chunk, the counts of all it asked for and which of the kept its words and pairs are."""

    def merge(t: pa.Table) -> pa.Table:
        r, mail = t.column("to")[0].as_py(), _mail(t)
        words, at = _distinct(np.concatenate([_unpack(m["a"]) for m in mail["ask_words"]]))
        count = np.bincount(at, np.concatenate([_u32(m["d"]) for m in mail["ask_words"]]), len(words)).astype(np.int64)
        u, w, c, back = _merged_pairs(mail["ask_pairs"])
        word_rows = list(zip([m["frm"] for m in mail["ask_words"]], np.split(at, np.cumsum([len(m["a"]) // 4 for m in mail["ask_words"]])[:-1])))
        pair_rows = list(zip([m["frm"] for m in mail["ask_pairs"]], back))
        del at, back, mail

        def told() -> Iterator[tuple]:
            nonlocal u, w, c, words, count
            for kind, rows, n, least in (("reply_words", word_rows, count, 1), ("reply_pairs", pair_rows, c, 2)):
                number = np.cumsum(n >= least) - 1
                for frm, x in rows:
                    yield r, frm, kind, _bytes(n[x], "<u4"), _bytes(_ascending(number, x, n[x] >= least), "<u4")
                rows.clear()
            words, count = words[count > 0], count[count > 0]
            token = words != U64(start)
            yield r, r, "words", _pack(words), None, None, _bytes(count, "<u4")
            yield r, r, "totals", np.array([count[token].sum(), token.sum()], "<i8").tobytes()
            u, w, c = u[c > 0], w[c > 0], c[c > 0]
            context, at = _distinct(u)
            single = np.bincount(at[c == 1], minlength=len(context))
            dish, own = _distinct(w)
            dealt = _deal((dish % U64(shards)).astype(np.int64), shards)
            twice = np.bincount(own[c > 1], minlength=len(dish))
            once = np.bincount(own[c == 1], minlength=len(dish))
            place = np.full(len(dish), -1, np.int64)  # of the dishes with pairs of two or more, in the order of shards
            kept = np.concatenate([x[twice[x] > 0] for x in dealt])
            place[kept] = np.arange(len(kept))
            two = c > 1
            yield r, r, "pairs", _pack(context), _bytes(single, "<u4"), np.concatenate([at[two], place[own[two]], c[two]]).astype("<u4").tobytes(), _bytes(np.array([(twice[x] > 0).sum() for x in dealt]), "<u4")
            for s, x in enumerate(dealt):
                yield s, r, "customers", _pack(dish[x]), _bytes(once[x], "<u4"), None, _bytes(twice[x], "<u4")
            mine = np.isin(context, hot)
            yield r, r, "hot", _pack(context[mine]), _bytes(np.bincount(at, minlength=len(context))[mine], "<u4")

        return pa.Table.from_batches([_rows(told())])

    return merge


def _settle(t: pa.Table) -> pa.Table:
    """Shard: what stays the same about its words: customers from pairs of one, and whose pairs of two or more are told."""
    r, mail = t.column("to")[0].as_py(), _mail(t)
    words = _unpack(mail["words"][0]["a"])
    const = np.zeros(len(words), np.int64)
    index, sizes, out = [], [], []
    for m in mail.get("customers", []):
        at = np.searchsorted(words, _unpack(m["a"]))
        np.add.at(const, at, _u32(m["b"]))
        twice = _u32(m["d"])
        index.append(at[twice > 0])
        sizes.append((m["frm"], int((twice > 0).sum())))
        out.append((r, m["frm"], "count", None, None, None, _bytes(twice[twice > 0], "<u4")))
    out.append((r, r, "known", _bytes(const, "<u4"), _bytes(np.concatenate(index), "<u4"), np.array(sizes, "<i8").tobytes()))
    return pa.Table.from_batches([_rows(out)])


def _seat_words(sweep: int, seed: int, tables: int, known: int, keep: bool):
    """Shard: seat its words' customers in the shared restaurant; tells each sender of pairs its words' share of a draw of
    the restaurant's measure, times the `sums` of all."""
    d, theta = WORDS
    rate = float(draw_rates(np.array(tables), d, theta, np.random.default_rng([seed, sweep, 3])))

    def seat(t: pa.Table) -> pa.Table:
        r, mail = t.column("to")[0].as_py(), _mail(t)
        state = mail["known"][0]
        c = _u32(state["a"])
        index, sizes = _u32(state["b"]), np.frombuffer(state["c"], "<i8").reshape(-1, 2)
        counts = {m["frm"]: _u32(m["d"]) for m in mail.get("count", [])}
        parts = np.split(index, np.cumsum(sizes[:, 1])[:-1])
        for (frm, _), at in zip(sizes, parts):
            c[at] += counts[frm]
        rng = np.random.default_rng([seed, sweep, r, 1])
        n = draw_tables(c, np.full(len(c), rate / (known + 1)), d, rng)
        held = rng.gamma(np.maximum(c - d * n, 0))
        out = [(frm, r, "parent", _bytes(held[at], "<f4")) for (frm, _), at in zip(sizes.tolist(), parts)]
        out.append((r, r, "sums", np.array([c.sum(), n.sum(), held.sum()], "<f8").tobytes()))
        if keep:
            out.append((r, sweep, "word_sample", _bytes(c - d * n, "<f4")))
        return pa.Table.from_batches([_rows(out)])

    return seat


def _seat_pairs(sweep: int, seed: int, tables: int, held: float, known: int, hot: dict[int, int], keep: bool):
    """Shard: seat the customers of its pairs of two or more; tells the words' shards their tables."""
    d, theta = CONTEXTS
    rest = np.random.default_rng([seed, sweep, 4]).gamma(WORDS[1] + WORDS[0] * tables)

    def seat(t: pa.Table) -> pa.Table:
        r, mail = t.column("to")[0].as_py(), _mail(t)
        state = mail["pairs"][0]
        context, single = _unpack(state["a"]), _u32(state["b"])
        at, dish, c = np.split(_u32(state["c"]), 3)
        to = _u32(state["d"])
        num = np.concatenate([_f32(m["a"]) for m in mail.get("parent", [])] or [np.zeros(0)])
        p = (num + rest / (known + 1)) / (held + rest)
        old = _u32(mail["seats"][0]["a"]) if "seats" in mail else np.ones(len(c), np.int64)
        total = single + np.bincount(at, old, len(context)).astype(np.int64)
        rng = np.random.default_rng([seed, sweep, r, 2])
        rate = draw_rates(total, d, theta, rng)
        is_hot = np.array([int(x) in hot for x in context], bool) if hot else np.zeros(len(context), bool)
        for i in np.flatnonzero(is_hot):  # the same draw wherever a context's dishes are
            u = int(context[i])
            rate[i] = draw_rates(np.array(hot[u]), d, theta, np.random.default_rng([seed, sweep, u, 5]))
        n = draw_tables(c, rate[at] * p[dish], d, rng)
        told = np.bincount(dish, n, len(num)).astype(np.int64)
        after = single + np.bincount(at, n, len(context)).astype(np.int64)
        out = [(s, r, "count", None, None, None, _bytes(x, "<u4")) for s, x in enumerate(np.split(told, np.cumsum(to)[:-1]))]
        out.append((r, r, "seats", _bytes(n, "<u4")))
        out.append((r, r, "hot", _pack(context[is_hot]), _bytes(after[is_hot], "<u4")))
        if keep:
            out.append((r, sweep, "pair_sample", _bytes(n, "<u4"), _bytes(after, "<u4")))
        return pa.Table.from_batches([_rows(out)])

    return seat


def _parent(num: np.ndarray, customers: int, tables: int, known: int) -> np.ndarray:
    """The predictive probability of words without context."""
    d, theta = WORDS
    return (num + (theta + d * tables) / (known + 1)) / (theta + customers)


def _answer(samples: int):
    """Shard: tells chunks, for their words, counts, c - d t and tables as contexts, and for their pairs the mean of c - d t."""
    d = CONTEXTS[0]

    def answer(t: pa.Table) -> pa.Table:
        r, mail = t.column("to")[0].as_py(), _mail(t)
        words = _unpack(mail["words"][0]["a"])
        num = [_f32(m["a"]) for m in mail["word_sample"]]
        context = _unpack(mail["pairs"][0]["a"])
        seats = [_u32(m["a"]) for m in mail["pair_sample"]]
        mean = sum(seats) / len(seats)
        tables = [np.zeros(len(words), np.int64) for _ in seats]
        at = np.minimum(np.searchsorted(words, context), max(len(words) - 1, 0))
        own = words[at] == context if len(words) else np.zeros(len(context), bool)  # not those of hot contexts kept elsewhere
        for t, m in zip(tables, mail["pair_sample"]):
            t[at[own]] = _u32(m["b"])[own]

        def told() -> Iterator[tuple]:
            for m in mail["reply_words"]:
                n, there = _u32(m["a"]), np.cumsum(_u32(m["b"]))
                known = n > 0
                v, tab = np.zeros((samples, len(n)), "<f4"), np.zeros((samples, len(n)), "<u4")
                for s in range(samples):
                    v[s, known], tab[s, known] = num[s][there], tables[s][there]
                yield m["frm"], r, "words", _bytes(n, "<u4"), v.tobytes(), tab.tobytes()
            for m in mail["reply_pairs"]:
                c, there = _u32(m["a"]), np.cumsum(_u32(m["b"]))
                v = c - d * np.minimum(c, 1)
                v[c > 1] = c[c > 1] - d * mean[there]
                yield m["frm"], r, "pairs", _bytes(v, "<f4")

        return pa.Table.from_batches([_rows(told())])

    return answer


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def pitman_yor_scores(docs: DataFrame, held: object | None = None, seed: int = 11) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    held = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2 if held is None else held, F.lit(False))
    chunks = materialise(_chunks(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held"))))
    tokens, n_chunks = chunks.select(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)), F.count("*")).first()
    if not n_chunks:
        return spark.createDataFrame([], _SCORES).withColumn("train_tokens", F.lit(0).cast("long"))
    shards = max(8, math.ceil(tokens / SHARD_TOKENS))
    def by_shard(rows: DataFrame, f) -> DataFrame:
        return rows.repartition(shards, "to").groupBy("to").applyInArrow(_sparing(f), _MESSAGE)

    numbers = materialise(by_shard(_hashes(chunks, shards), _number))
    sizes = np.zeros((shards, 2), np.int64)
    for m in numbers.where(F.col("kind") == "size").select("to", "a").collect():  # two numbers a shard
        sizes[m["to"]] = np.frombuffer(_open(m["a"]), "<i8")
    before = np.cumsum(sizes[:, 0]) - sizes[:, 0]
    if sizes[:, 0].sum() >= 1 << 32:
        raise ValueError("more than 2**32 words")
    start = int(before[int(START) % shards] + sizes[int(START) % shards, 1])
    hashed, chunks = chunks, materialise(_numbered(chunks, numbers.where(F.col("kind") == "numbers"), shards, before))
    discard(hashed, numbers)
    # a word of a share of 1 / (2 shards) is listed by chunks with half of its tokens at least; such lists hold 4 shards words at most
    hot = np.array(sorted(r["word"] for r in _heavy(chunks, 4 * shards).where(F.col("n") * (4 * shards) >= tokens).collect()), np.int64).astype(U64)

    def hot_tables(rows: DataFrame) -> dict[int, int]:
        """Tables of the contexts dealt by the pair, added up over shards: 4 shards numbers at most."""

        def opened(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches(it):
                for a, n in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(_unpack(_open(a)).astype(np.int64)), pa.array(_u32(_open(n)))], ["word", "n"])

        if not len(hot):
            return {}
        sums = rows.where(F.col("kind") == "hot").select("a", "b").mapInArrow(opened, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        return {r["word"]: r["n"] for r in sums.collect()}

    def added(rows: DataFrame, kind: str, numbers: str) -> list:
        """Sums of a few numbers a shard."""
        return np.sum([np.frombuffer(_open(m["a"]), numbers) for m in rows.where(F.col("kind") == kind).select("a").collect()], axis=0).tolist()

    merged = materialise(by_shard(_ask(chunks, shards, hot, start), _merge(shards, hot, start)))
    train, known = added(merged, "totals", "<i8")
    kind = F.col("kind")
    settled = materialise(by_shard(merged.where(kind.isin("words", "customers")), _settle))
    words_state, counts = settled.where(kind == "known"), settled.where(kind == "count")
    hot_now, tables, kept = hot_tables(merged), known, []
    lasting = materialise(merged.where(kind.isin("words", "pairs", "reply_words", "reply_pairs")))
    discard(merged)
    pairs_state, seats = lasting.where(kind == "pairs"), None
    sums = []
    done: list[DataFrame] = []
    for sweep in range(BURN + SAMPLES):
        keep = sweep >= BURN
        up = materialise(by_shard(words_state.unionByName(counts), _seat_words(sweep, seed, tables, known, keep)))
        customers, tables, drawn = added(up, "sums", "<f8")
        customers, tables = round(customers), round(tables)
        down_in = pairs_state.unionByName(up.where(kind == "parent"))
        down = materialise(by_shard(down_in if seats is None else down_in.unionByName(seats), _seat_pairs(sweep, seed, tables, drawn, known, hot_now, keep)))
        discard(*done)
        spark._jvm.System.gc()  # shuffle files go when nothing refers to them any more and the driver notices
        done = [] if keep else [up, down]  # the next sweep reads them, none after it
        counts, seats, hot_now = down.where(kind == "count"), down.where(kind == "seats"), hot_tables(down)
        if keep:
            kept += [up.where(kind == "word_sample"), down.where(kind == "pair_sample")]
            sums.append((customers, tables, hot_now))
    discard(settled)
    spark._jvm.System.gc()
    told = lasting
    for x in kept:
        told = told.unionByName(x)
    answers = by_shard(told, _answer(SAMPLES)).withColumnRenamed("to", "chunk")
    d, theta = CONTEXTS

    def score(key: object, own: pa.Table, mail: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        x = _Chunk(row, shards, hot, start)
        at_row = {x: i for i, x in enumerate(zip(mail.column("frm").to_pylist(), mail.column("kind").to_pylist()))}
        part = lambda r, kind, c: _open(mail.column(c)[at_row[r, kind]].as_buffer())
        n_w, n_p = len(x.words), len(x.u)
        count, num, tab, val = np.zeros(n_w, np.int64), np.zeros((SAMPLES, n_w), "<f4"), np.zeros((SAMPLES, n_w), "<u4"), np.zeros(n_p)
        for r in range(shards):
            at = x.word_cut[r]
            count[at] = _u32(part(r, "words", "a"))
            num[:, at] = np.frombuffer(part(r, "words", "b"), "<f4").reshape(SAMPLES, -1)
            tab[:, at] = np.frombuffer(part(r, "words", "c"), "<u4").reshape(SAMPLES, -1)
            val[x.pair_cut[r]] = _f32(part(r, "pairs", "a"))
        prob = np.zeros(n_p)
        for s, (customers, tables, hot_tab) in enumerate(sums):
            for w, n in hot_tab.items():
                i = np.searchsorted(x.words, U64(w))
                if i < n_w and x.words[i] == U64(w):
                    tab[s, i] = n
            p = _parent(num[s].astype(np.float64), customers, tables, known)
            prob += (val + (theta + d * tab[s][x.u]) * p[x.w]) / (theta + count[x.u])
        base = np.log10((count + 1) / (train + known + 1))
        ends = lambda v, at: np.add.reduceat(v[at], x.first, dtype=v.dtype) if len(x.first) else np.zeros(0)
        out = pa.table(
            {
                "doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": x.lens,
                "n_known": ends((count > 0).astype(np.int64), x.toks), "base_score": ends(base, x.toks), "score": ends(np.log10(prob / SAMPLES), x.pair),
            }
        )
        del x, row, count, num, tab, val, prob, base
        release_memory()
        return out

    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, _SCORES)
    return scored.withColumn("train_tokens", F.lit(train).cast("long"))


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, perplexity and base_perplexity: ten to the mean negative score of a token."""
    mean = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(mean("score").alias("perplexity"), mean("base_score").alias("base_perplexity"))
