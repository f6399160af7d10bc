"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The model file is of the BPE kind. Its encoding of a text is the one path through the lattice of pieces on which
every two neighbours are `compatible`, that is, encode to themselves when put together. With weight 0 for
compatible neighbours and minus infinity for others it is the best path, and max-plus algebra applies. A giant
document is cut into chunks. The state at a cut is the piece that ends at it or crosses it. Each chunk yields the
matrix of weights from the states at its left cut to those at its right cut. A document's matrices are multiplied
up a tree, which gives the best state at every cut, and then each chunk traces its own pieces back from its two states.

No piece goes from another character to a blank mark, so before a word the state is always the same. Inside a
chunk, what lies between its first and last such place is encoded by the library; lattices are searched at the
edges only, or through the whole chunk where a word is longer than that. Cuts keep off words that follow a run
of blanks, as the pieces for runs all have one score. Smaller documents are one chunk without a cut.

Cases: null and empty texts have no ids and decode to the empty text. Equal texts have equal ids, giant ones are
encoded once. An empty table gives an empty result; other columns are ignored. Texts that hold the blank mark
U+2581 itself are encoded, but decode to a blank there (`restored` is false).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialise, public_tokenizer

BLANK = "▁"
#: Code points of a chunk; longer documents are giant.
CHUNK = 16_384


class PieceLattice:
    """The pieces of a model and which of them can stand next to each other."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        special = lambda i: self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i)
        self.ids = {self.library.id_to_piece(i): i for i in range(n) if not special(i)}
        self.score = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.sound: dict[str, bool] = {}

    def merge(self, text: str) -> list[str]:
        """The model's pieces of a short text: the best-scored neighbours are joined first, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            score, at = max((self.score.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if score == float("-inf"):
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def usable(self, piece: str) -> bool:
        """Whether a string can stand in a path: a piece that encodes to itself, or a single character without a piece."""
        if piece not in self.ids:
            return len(piece) == 1
        if piece not in self.sound:
            self.sound[piece] = self.merge(piece) == [piece]
        return self.sound[piece]

    def numbers(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else self.library.encode(piece)[1:]

    def compatible(self, a: str, b: str) -> bool:
        key = a, b
        if key not in self.pairs:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[key] = self.merge(a + b) == [a, b]
        return self.pairs[key]

    def word_starts(self, s: str, i: int) -> bool:
        """Whether no piece goes across position i: a blank mark after another character, or before a character without a piece."""
        return i <= 0 or i >= len(s) or (s[i] == BLANK and s[i - 1] != BLANK) or s[i] not in self.ids

    def cuts(self, s: str, chunk: int) -> list[int]:
        """Where a normalised text is cut: about every `chunk` characters, not in a word that follows a run of blanks."""
        out, at = [0], chunk
        while at < len(s) - self.longest:
            p = at
            while p < len(s) and not self.word_starts(s, p):
                run = s.rfind(BLANK, out[-1], p)
                if run >= 1 and s[run - 1] == BLANK or s[p - 1] == BLANK or s[p - 1] not in self.ids:
                    p += 1
                else:
                    break
            if p >= len(s):
                break
            out.append(p)
            at = p + chunk
        return [*out, len(s)]

    def states(self, s: str, p: int) -> list[tuple[int, int]]:
        """The pieces at cut p, as start and end against p; (0, 0) where a word starts."""
        if self.word_starts(s, p):
            return [(0, 0)]
        lo = p
        while lo > max(0, p - self.longest) and not self.word_starts(s, lo):
            lo -= 1
        hi = p
        while hi < min(len(s), p + self.longest) and not self.word_starts(s, hi):
            hi += 1
        return [(a - p, b - p) for a in range(lo, p) for b in range(p, hi + 1) if self.usable(s[a:b])]

    def walk(self, s: str, begin: list[tuple[int, str | None, int]], stop: int, over: int) -> dict[int, dict[str, tuple[int, tuple | None]]]:
        """All compatible paths from nodes (position, last piece, bits), by end position and last piece: the bits of the
        starts that reach it, and the node before. Pieces start before `stop` and end at `over` at most."""
        reach: dict[int, dict] = {}
        for pos, piece, bits in begin:
            old = reach.setdefault(pos, {}).get(piece, (0, None))
            reach[pos][piece] = (old[0] | bits, None)
        for pos in range(min(reach, default=stop), stop):
            here = reach.get(pos)
            if not here:
                continue
            for end in range(pos + 1, min(over, pos + self.longest) + 1):
                piece = s[pos:end]
                if not self.usable(piece):
                    continue
                bits, before = 0, None
                for last, (b, _) in here.items():
                    if last is None or self.compatible(last, piece):
                        bits, before = bits | b, (pos, last)
                if bits:
                    reach.setdefault(end, {})[piece] = (bits, before)
        return reach

    def edges(self, s: str, p: int, q: int) -> tuple[int, int] | None:
        """The first and the last start of a word in p..q, None if there is none."""
        a = p
        while a <= q and not self.word_starts(s, a):
            a += 1
        if a > q:
            return None
        b = q
        while not self.word_starts(s, b):
            b -= 1
        return a, b

    def transfer(self, s: str, p: int, q: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
        """The finite entries of the matrix from the states at p to those at q."""
        left, right = self.states(s, p), self.states(s, q)
        begin = [(p + b, s[p + a : p + b] or None, 1 << k) for k, (a, b) in enumerate(left)]
        middle = self.edges(s, p, q)
        if middle:
            a, b = middle
            done = self.walk(s, begin, a, a).get(a, {})
            into = 0
            for bits, _ in done.values():
                into |= bits
            out = self.walk(s, [(b, None, 1)], q, len(s)) if (0, 0) not in right else {}
            good = [r for r in right if r == (0, 0) or out.get(q + r[1], {}).get(s[q + r[0] : q + r[1]])]
            return [(x, r) for k, x in enumerate(left) if into >> k & 1 for r in good]
        reach = self.walk(s, begin, q, len(s))
        found = []
        for r in right:
            bits = reach.get(q + r[1], {}).get(s[q + r[0] : q + r[1]], (0, None))[0]
            found += [(x, r) for k, x in enumerate(left) if bits >> k & 1]
        return found

    def inside(self, s: str) -> list[int]:
        """The library's ids of a text that starts a word."""
        if not s:
            return []
        if s[0] == BLANK:
            return self.library.encode(s[1:].replace(BLANK, " ")) if len(s) > 1 else [self.ids[BLANK]]
        return self.library.encode(s.replace(BLANK, " "))[1:]  # the mark that the library puts in front stays alone

    def trace(self, s: str, p: int, q: int, x: tuple[int, int], r: tuple[int, int]) -> list[int]:
        """The ids of the pieces that start in p..q, between two states."""

        def back(reach: dict, pos: int, piece: str | None) -> list[int]:
            out = []
            while (before := reach[pos][piece][1]) is not None:
                out.append(self.numbers(piece))
                pos, piece = before
            return [i for x in out[::-1] for i in x]

        begin = [(p + x[1], s[p + x[0] : p + x[1]] or None, 1)]
        middle = self.edges(s, p, q)
        if not middle:
            return back(self.walk(s, begin, q, len(s)), q + r[1], s[q + r[0] : q + r[1]])
        a, b = middle
        first = self.walk(s, begin, a, a)
        out = back(first, a, next(iter(first[a])))
        out += self.inside(s[a:b])
        if r != (0, 0):
            out += back(self.walk(s, [(b, None, 1)], q, len(s)), q + r[1], s[q + r[0] : q + r[1]])
        return out


Matrix = list[tuple[tuple[int, int], tuple[int, int]]]


def product(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two matrices of weights 0 and minus infinity, as their finite entries. It is associative."""
    onward: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y, r in b:
        onward.setdefault(y, []).append(r)
    return sorted({(x, r) for x, y in a for r in onward.get(y, ())})


def combine(matrices: list[Matrix]) -> list[tuple[int, int]]:
    """The best state at every cut, between the text's two ends.

    Products go up a tree, two neighbours at a time. Then states come down: each node knows the states at its two ends and
    tells its halves the state between them. All nodes of a level are independent of each other.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([product(*below[i : i + 2]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
    if ((0, 0), (0, 0)) not in levels[-1][0]:
        raise ValueError("no path through the lattice")
    states = [(0, 0), (0, 0)]
    for below in levels[-2::-1]:
        down = []
        for k, (x, r) in enumerate(zip(states, states[1:])):
            down.append(x)
            if 2 * k + 1 < len(below):
                into = {y for y, end in below[2 * k + 1] if end == r}
                down.append(next(y for start, y in below[2 * k] if start == x and y in into))
        states = [*down, states[-1]]
    return states


def _lattice(path: str) -> PieceLattice:
    if path not in _LOADED:
        _LOADED[path] = PieceLattice(path)
    return _LOADED[path]


_LOADED: dict[str, PieceLattice] = {}


def _answer(lattice: PieceLattice, ids: list[list[int]], crc: list[int | None]) -> list[pa.Array]:
    """Columns ids, n_ids, decoded_crc32 and restored."""
    back = [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in lattice.library.decode(ids)] if ids else []
    same = [a == b for a, b in zip(back, crc)]
    return [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(back, pa.int64()), pa.array(same, pa.bool_())]


def subword_ids(docs: DataFrame, model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids, n_ids, decoded_crc32 and restored (decoding gives the text back) of every document."""
    model = model or public_tokenizer("piece_bpe_32k.model")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    answer = "ids array<int>, n_ids long, decoded_crc32 long, restored boolean"
    names = ["ids", "n_ids", "decoded_crc32", "restored"]

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for b in batches(it):
            ids = lattice.library.encode(b.column("text").to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_answer(lattice, ids, b.column("crc").to_pylist())], ["doc_id", *names])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        margin = 2 * lattice.longest
        for b in batches(it):
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                s = BLANK + text.replace(" ", BLANK)
                at = lattice.cuts(s, chunk)
                made = [(key, i, s[max(0, p - margin) : q + margin], min(p, margin), min(p, margin) + q - p) for i, (p, q) in enumerate(zip(at, at[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()))], ["key", "i", "s", "p", "q"])

    def matrices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for b in batches(it):
            found = [json.dumps(lattice.transfer(*x)) for x in zip(*(b.column(c).to_pylist() for c in ("s", "p", "q")))]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("i"), pa.array(found, pa.string())], ["key", "i", "matrix"])

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for key, run in zip(b.column("key").to_pylist(), b.column("run").to_pylist()):
                states = combine([[(tuple(x), tuple(r)) for x, r in json.loads(m["matrix"])] for m in run])
                pairs = [json.dumps([x, r]) for x, r in zip(states, states[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(run), pa.string()), pa.array(range(len(run)), pa.int32()), pa.array(pairs, pa.string())], ["key", "i", "ends"])

    def trace(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for b in batches(it):
            found = []
            for s, p, q, ends in zip(*(b.column(c).to_pylist() for c in ("s", "p", "q", "ends"))):
                x, r = json.loads(ends)
                found.append(lattice.trace(s, p, q, tuple(x), tuple(r)))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("i"), pa.array(found, pa.list_(pa.int32()))], ["key", "i", "ids"])

    def back(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for b in batches(it):
            ids = b.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_answer(lattice, ids, b.column("crc").to_pylist())], ["doc_id", *names])

    giant = F.length("text") > chunk
    small = rows.where(~giant).mapInArrow(whole, f"doc_id long, {answer}")
    keyed = rows.where(giant).withColumn("key", F.sha2("text", 256))
    texts = keyed.dropDuplicates(["key"]).select("key", "text")
    chunks = materialise(texts.mapInArrow(cut, "key string, i int, s string, p int, q int").repartition("key", "i"))
    found = chunks.select("key", "i", "s", "p", "q").mapInArrow(matrices, "key string, i int, matrix string")
    runs = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "matrix"))).alias("run"))  # small matrices of one document
    states = runs.mapInArrow(scan, "key string, i int, ends string")
    traced = chunks.join(states, ["key", "i"]).select("key", "i", "s", "p", "q", "ends").mapInArrow(trace, "key string, i int, ids array<int>")
    ids = traced.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])).alias("ids"))
    big = keyed.select("doc_id", "crc", "key").join(ids, "key").select("doc_id", "crc", "ids").mapInArrow(back, small.schema)
    return small.unionByName(big)


def decode_ids(table: DataFrame, model: str | None = None) -> DataFrame:
    """table (doc_id, ids) with the text that the ids stand for, instead of them."""
    model = model or public_tokenizer("piece_bpe_32k.model")

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for b in batches(it):
            texts = lattice.library.decode([x or [] for x in b.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return table.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")
