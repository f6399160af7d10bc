"""Best-fit packing by a grouping genetic algorithm on islands.

Texts become token ids, ids become pieces of at most `capacity`, and pieces are packed into as few sequences as
can be. Full pieces are sequences of their own. The rest is dealt into blocks of bounded size; every block is a
bin-packing problem that several islands work on with populations of their own. An individual is a list of
bins. Crossover injects the well-filled bins of one parent into the other, removes the bins that now hold
duplicates, and puts the displaced pieces back by best fit. In a block of many bins those that are filled well stay,
and the others are bred. After each epoch an island's elite migrates to the
next island of its ring. A block is done when its number of bins reaches the lower bound, ceil(sum / capacity).
Blocks do not keep pieces apart for good: bins that are not full, the emptiest first and up to half of a block's pieces, are
reopened and meet those of other blocks in new, fewer blocks, in which the old bins are the first individual. That goes on
until one block is left, or until what is reopened needs as many bins as it has.

Tokenising is exact and cheap by words: the tokenizer drops white space before it merges, so what stands
between blanks is encoded once and looked up after that.

Cases: null text is empty and has one id, 0. Equal rows are packed apart, each once. Order of pieces in a
sequence has no meaning. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Tables, batches, discard, materialise, mix64, public_tokenizer, release_memory
from .merges import WordMerges

CAPACITY = 2048
#: Pieces of a block, about; bounds the memory and time of a task.
BLOCK = 8192
ISLANDS = 2
EPOCHS = 2
POPULATION = 10
GENERATIONS = 60
#: Bins that are bred at once.
BRED = 128
#: Words whose ids a worker keeps; when there are more it keeps those of the last batch.
KEPT_WORDS = 350_000


class WordEncoder:
    """Token ids of many texts, encoding each distinct word between blanks once.

    The tokenizer splits at white space and never joins across it, so a text's ids are those of its words in order.
    New words of plain letters, with a final `.` or `,` or none, are merged together with arrays; others go to the
    library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = WordMerges(self.tokenizer)
        self.at: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.size = np.zeros(0, np.int64)

    def _forget(self, words: list[str]) -> None:
        """Keep no others than these words."""
        kept = [w for w in words if w in self.at]
        old = np.array([self.at[w] for w in kept], np.int64)
        n = self.size[old]
        take = np.repeat((np.cumsum(self.size) - self.size)[old] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.at, self.flat, self.size = dict(zip(kept, range(len(kept)))), self.flat[take], n

    @staticmethod
    def _letters(word: str) -> str:
        """The letters of a plain word, empty for another: letters that lower case and normal form leave one to one."""
        letters = word[:-1] if word[-1:] in (".", ",") else word
        return letters if letters.isalpha() and len(letters) <= 64 and max(letters) < "\u0130" else ""

    def _learn(self, words: list[str]) -> None:
        letters = [self._letters(w) for w in words]
        plain = [w for w, x in zip(words, letters) if x]
        other = [w for w, x in zip(words, letters) if not x]
        flat, size = [], []
        if plain:
            ids, n = self.merges.encode([x.lower().encode() for x in letters if x])
            mark = np.array([self.merges.end[ord(w[-1])] if w[-1] in ".," else 0 for w in plain], np.uint32)
            marked = np.flatnonzero(mark)
            flat.append(np.insert(ids, np.cumsum(n)[marked], mark[marked]))
            n[marked] += 1
            size.append(n)
        for i in range(0, len(other), 1024):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(other[i : i + 1024], add_special_tokens=False)]
            size.append(np.array([len(x) for x in got], np.int64))
            flat.append(np.array([y for x in got for y in x], np.uint32))
        self.at.update(zip(plain + other, range(len(self.at), len(self.at) + len(words))))
        self.flat = np.concatenate([self.flat, *flat])
        self.size = np.concatenate([self.size, *size])

    def encode(self, texts: pa.Array, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, each text followed by `end`, and the offsets of the texts."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = list(map(self.at.get, words))
        if new := [w for w, i in zip(words, which) if i is None]:
            if len(self.at) + len(new) > KEPT_WORDS:
                self._forget(words)
            self._learn(new)
            which = list(map(self.at.get, words))
        start = np.append(np.cumsum(self.size) - self.size, len(self.flat))
        size = np.append(self.size, 1)
        flat = np.append(self.flat, np.uint32(end))
        which = np.append(np.array(which, np.int64), len(self.size))
        stop = np.asarray(split.offsets)[1:] - np.asarray(split.offsets)[0]
        seq = which[np.insert(coded.indices.to_numpy(), stop, len(words))]
        n = size[seq]
        upto = np.cumsum(n)
        take = np.arange(upto[-1] if len(upto) else 0)
        take += np.repeat(start[seq] - (upto - n), n)
        off = np.concatenate([[0], upto[stop + np.arange(len(stop))]])
        return flat[take], off


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a number `spread` that differs between all pieces."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = WordEncoder(tokenizer), TaskContext.get().partitionId() << 36
        for b in batches(it, 8 << 20):
            ids, off = encoder.encode(b.column("text"))
            size = np.diff(off)
            n = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, size[row] - start)
            data = ids.astype("<u4")
            crc = [zlib.crc32(data[a : a + m]) for a, m in zip((off[row] + start).tolist(), length.tolist())]
            spread = np.arange(at, at + len(row))
            at += len(row)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(spread)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "spread"],
            )
        del encoder
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, spread long")


class Groups:
    """The grouping algorithm for one block: individuals are lists of bins, bins are lists of item numbers."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity, self.rng = sizes.tolist(), capacity, np.random.default_rng(seed)
        self.bound = -(-int(sizes.sum()) // capacity)

    def fill(self, bins: list[list[int]], items: list[int]) -> list[list[int]]:
        """Put items into the bins by best fit, in the order given."""
        bins = [list(b) for b in bins]
        room = sorted((self.capacity - sum(self.sizes[i] for i in b), k) for k, b in enumerate(bins))
        for i in items:
            at = bisect_left(room, (self.sizes[i], -1))
            if at < len(room):
                left, k = room.pop(at)
                bins[k].append(i)
            else:
                left, k = self.capacity, len(bins)
                bins.append([i])
            if left > self.sizes[i]:
                insort(room, (left - self.sizes[i], k))
        return bins

    def falling(self, items: list[int]) -> list[int]:
        return sorted(items, key=lambda i: (-self.sizes[i], i))

    def fresh(self, noise: float) -> list[list[int]]:
        """Best fit in falling order, with the order disturbed by noise."""
        n = len(self.sizes)
        keys = np.array(self.sizes) * (1 + noise * self.rng.random(n))
        return self.fill([], np.argsort(-keys, kind="stable").tolist())

    def worth(self, bins: list[list[int]]) -> tuple[int, float]:
        """Few bins first, then uneven filling, which leaves room that is of use."""
        full = np.array([sum(self.sizes[i] for i in b) for b in bins], float)
        return -len(bins), float(((full / self.capacity) ** 2).mean()) if len(bins) else 0.0

    def cross(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        """Inject whole well-filled bins of b into a."""
        full = [sum(self.sizes[i] for i in x) for x in b]
        best = sorted(range(len(b)), key=lambda k: (-full[k], k))[: max(1, len(b) // 2)]
        some = [b[k] for k in best if self.rng.random() < 0.5] or [b[best[0]]]
        taken = {i for x in some for i in x}
        kept = [x for x in a if taken.isdisjoint(x)]
        displaced = [i for x in a if not taken.isdisjoint(x) for i in x if i not in taken]
        return self.fill(some + kept, self.falling(displaced))

    def mutate(self, a: list[list[int]]) -> list[list[int]]:
        """Open the emptiest bins and a few others and fill anew."""
        full = [sum(self.sizes[i] for i in x) for x in a]
        order = sorted(range(len(a)), key=lambda k: (full[k], k))
        out = set(order[: max(1, len(a) // 20)]) | set(self.rng.integers(0, len(a), max(1, len(a) // 20)).tolist())
        return self.fill([x for k, x in enumerate(a) if k not in out], self.falling([i for k in out for i in a[k]]))

    def breed(self, pool: list[list[list[int]]], population: int, generations: int) -> list[list[int]]:
        """The best individual after the generations, or as soon as one meets the lower bound."""
        pool = list(pool)
        done = lambda: any(len(x) <= self.bound for x in pool)
        while len(pool) < population and not done():
            pool.append(self.fresh(0.1 * len(pool)))
        for _ in range(generations):
            if done():
                break
            pool.sort(key=self.worth, reverse=True)
            i, j = self.rng.choice(len(pool), 2, replace=False) if len(pool) > 1 else (0, 0)
            pool = pool[: max(1, population - 2)] + [self.cross(pool[i], pool[j]), self.mutate(pool[min(i, j)])]
        return max(pool, key=self.worth)

    def evolve(self, immigrants: list[list[list[int]]], population: int, generations: int, bins: int = BRED) -> list[list[int]]:
        """A better packing than the immigrants' and best fit's, unless these meet the lower bound.

        Whole individuals are bred if they have few bins. Of many, those that are filled well stay as they are, and the
        emptiest ones and some others are a problem of their own, in which breeding gets far with little work.
        """
        pool = list(immigrants) or [self.fresh(0.0)]
        best = max(pool, key=self.worth)
        if len(best) <= self.bound:
            return best
        if len(best) <= bins:
            return self.breed(pool, population, generations)
        full = [sum(self.sizes[i] for i in x) for x in best]
        order = sorted(range(len(best)), key=lambda k: (full[k], k))
        out = set(order[: bins * 3 // 4]) | set(self.rng.choice(order[bins * 3 // 4 :], bins - bins * 3 // 4, replace=False).tolist())
        items = [i for k in sorted(out) for i in best[k]]
        own = {i: n for n, i in enumerate(items)}
        part = Groups(np.array([self.sizes[i] for i in items]), self.capacity, int(self.rng.integers(1 << 62)))
        bred = part.breed([[[own[i] for i in best[k]] for k in sorted(out)]], population, generations)
        after = [x for k, x in enumerate(best) if k not in out] + [[items[n] for n in x] for x in bred]
        return max((best, after), key=self.worth)


def _bins_to_blob(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _blob_to_bins(blob: bytes) -> list[list[int]]:
    at = np.frombuffer(blob, "<i4")
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(at) else []


def pack_islands(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """pieces (a materialised table with length and spread) with sequence_id and offset. Which pieces share a sequence
    depends on the pieces alone."""
    tables = Tables()
    names = [c for c in pieces.columns if c != "spread"]
    alike = [F.col(c) for c in names]
    out = [pieces.where(F.col("length") >= capacity).select(*names, (-1 - F.col("spread")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    n = pieces.where(F.col("length") < capacity).count()
    # dealt by what they are, so that the packing is the same however rows lie; equal pieces are counted and numbered
    rest = pieces.where(F.col("length") < capacity).groupBy(*names).agg(F.count("*").alias("_n")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    rest = rest.select(*names, F.xxhash64(*alike, "_copy").alias("_key"), F.lit(-1).cast("long").alias("_bin"))
    level = 0
    while True:
        blocks = max(1, -(-n // block))
        dealt = F.col("_key") if level == 0 else F.xxhash64("_bin", F.lit(level))  # bins stay whole
        placed = _pack_blocks(rest.withColumn("block", F.pmod(dealt, F.lit(blocks)).cast("int")), names, tables, capacity, blocks, islands, epochs, level)
        again = placed.where("reopened")
        n, bins, size = again.agg(F.count("*"), F.count_distinct("sequence_id"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if blocks == 1 or -(-size // capacity) >= bins:
            out.append(placed.select(*names, "sequence_id", "offset"))
            break
        out.append(placed.where("not reopened").select(*names, "sequence_id", "offset"))
        rest, level = again.select(*names, "_key", F.col("sequence_id").alias("_bin")), level + 1
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return tables.result(whole)


def _pack_blocks(rest: DataFrame, names: list[str], tables: Tables, capacity: int, blocks: int, islands: int, epochs: int, level: int) -> DataFrame:
    """Pieces, each block packed for itself, with sequence_id, offset, _key and whether their bin is to be reopened."""
    problem = rest.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("_key", "_bin", *names))).alias("items"))  # about `block` items
    problem = problem.select("block", "items", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.array().cast("array<binary>").alias("elites"))
    kind = problem.select("block", "island").schema.add("best", "binary").add("bins", "integer")
    state = tables.hold(problem.repartition(max(1, min(blocks * islands, 10_000)), "block", "island"))
    for epoch in range(epochs):

        def evolve(it: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            for b in batches(it):
                for i in range(b.num_rows):
                    k, isle = b.column("block")[i].as_py(), b.column("island")[i].as_py()
                    sizes = np.array(b.column("sizes")[i].as_py(), np.int64)
                    groups = Groups(sizes, capacity, int(mix64(np.array([level * 1_000_003 + k * 1009 + isle * 31 + epoch], U64))[0] >> U64(1)))
                    elites = [_blob_to_bins(x) for x in b.column("elites")[i].as_py()]
                    if level and epoch == 0:
                        old = np.unique(b.column("olds")[i].values.to_numpy(), return_inverse=True)[1]
                        elites = [_blob_to_bins(old.astype("<i4").tobytes()), groups.fresh(0.0)]
                    best = groups.evolve(elites, POPULATION, GENERATIONS)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([isle], pa.int32()), pa.array([_bins_to_blob(best, len(sizes))], pa.binary()), pa.array([len(best)], pa.int32())], ["block", "island", "best", "bins"]
                    )
                    del groups, elites, best
                    release_memory()

        fed = state if epoch == 0 else state.drop("elites").join(elites, ["block", "island"])
        given = ["block", "island", F.transform("items", lambda x: x["length"]).alias("sizes"), F.transform("items", lambda x: x["_bin"]).alias("olds"), "elites"]
        result = tables.hold(fed.select(*given).mapInArrow(evolve, kind))
        moved = result.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("best").alias("guest"))
        elites = result.join(moved, ["block", "island"]).select("block", "island", F.array("best", "guest").alias("elites"))
    best = result.groupBy("block").agg(F.min(F.struct("bins", "island", "best")).alias("b")).select("block", "b.best")
    placed = state.where(F.col("island") == 0).select("block", "items").join(best, "block")

    def unfold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for i in range(b.num_rows):
                items = b.column("items")[i].values
                bins = np.frombuffer(b.column("best")[i].as_py(), "<i4").astype(np.int64)
                length = items.field("length").to_numpy()
                order = np.argsort(bins, kind="stable")
                run = np.cumsum(length[order]) - length[order]
                first = np.concatenate([[True], np.diff(bins[order]) != 0])
                offset = np.empty(len(bins), np.int64)
                offset[order] = run - np.maximum.accumulate(np.where(first, run, 0))
                ids = (level << 56) + (b.column("block")[i].as_py() << 32) + bins
                columns = [*[items.field(c) for c in names], pa.array(ids), pa.array(offset), items.field("_key"), pa.array(_reopened(bins, length, capacity)[bins])]
                yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset", "_key", "reopened"])

    kind = rest.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "_key", F.lit(False).alias("reopened")).schema
    return tables.hold(placed.mapInArrow(unfold, kind))


def _reopened(bins: np.ndarray, length: np.ndarray, capacity: int) -> np.ndarray:
    """For each bin, whether it is to be reopened: not full, and among the emptiest that hold up to half of the pieces."""
    n, full = np.bincount(bins), np.bincount(bins, length)
    order = np.argsort(full, kind="stable")
    out = np.zeros(len(n), bool)
    out[order] = (np.cumsum(n[order]) <= len(bins) // 2) & (full[order] < capacity)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = materialise(pieces_of(docs, tokenizer or public_tokenizer("word_bpe_49k.json"), capacity))
    out = pack_islands(pieces, capacity)
    discard(pieces)
    return out
