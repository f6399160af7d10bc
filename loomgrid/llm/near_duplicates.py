"""Near-duplicate detection by an LSH forest over MinHash signatures, with links confirmed on the full shingle sets.

A document's set holds its distinct k-word shingles (fewer words: the whole sequence as one). Equal sets are one
class from the start. Each class has a signature of TREES x LEVELS minima, a byte each. A tree is a sorted order of the
classes: tree t's label of a class is the signature read from position t x LEVELS on, so labels go on into the minima
of the next trees where their own do not suffice, and are never too short. All trees' labels are sorted together,
dealt by range, and each task walks through its part by the longest common prefixes of neighbours. Classes that share
DEPTH levels are a region of the tree. A region of more than REGION classes is told apart by as many more levels as it
takes, in each part of it as many as that part needs.

Inside a region a leader (the class nearest to the region's most usual signature) is compared by a sketch, the rest of
the label, with all classes not yet taken; those that look linked are taken, and the next leader is chosen from the
rest. So a region of g copies yields about g pairs, not g * g. Leaders of regions that had to be told apart meet again
at the least depth at which few enough are left. A class near a leader (FLAG) that it does
not take is paired with the nearest of those it took: by the triangle inequality of the Jaccard distance, whoever is
linked to one of them is near the leader. Pairs are decided on the full sets, first each class's best one. Then some
classes ask: they are compared with all members of a group, in blocks, by their whole signatures, and where these leave
it open on the full sets; only links are told:

- where two components had a pair that was not confirmed, the classes of one ask the other;
- a class that a leader took without being linked to it asks all that were paired through that leader;
- in a region of DEPTH that was told apart or cut, classes outside its largest component ask that component and one
  another.

So no link that the regions of depth DEPTH hold is lost, but for sketches that are off by four standard deviations.

Two sets of similarity 0.8 share no region with a probability of (1 - 0.8**DEPTH)**TREES, 3e-5.

Cases: documents without words or text have an empty set, link with nothing and stand for themselves. Rows that
repeat a doc_id are one document, linked if any of its rows is. A null doc_id can't be named: its component is
null and it is kept. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Tables, batches, mix64, text_bytes, word_hashes
from .components import connected_components

TREES, LEVELS, DEPTH = 20, 6, 4
#: Levels of a label.
LABEL = 64
#: Classes of a region that are compared in one place; larger ones are told apart by more levels.
REGION = 256
#: Rows that a task holds at a time; a region of more counts as cut.
HELD = 50_000
#: Levels of a label that estimate similarity: those after the first DEPTH, on which all of a region agree.
SKETCH = LABEL - DEPTH
#: Matching levels from which a pair looks linked, is to be decided, or is near: 0.8, and 0.8 and 0.6 less four standard deviations.
LOOKS, DECIDE, FLAG = 47, 35, 20
_SMALL = 24
#: Members of a group and those who ask that meet in one place, and matching minima of the signature from which the sets decide (as DECIDE).
BLOCK, ASKERS, ASKED = 1500, 20_000, 78
#: Groups of more than a block that are broadcast; beyond that, tasks over which rows of one group are joined.
MOST_LARGE, SALTS = 50_000, 32
#: Bits of the bitmap that keeps texts nobody asks for from being moved.
BITMAP = 1 << 23


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text, its distinct shingles as sorted 64-bit hashes."""
    h, first = word_hashes(raw, off)
    if len(h) >= k:
        run = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            run = mix64(run * U64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    for i in range(len(off) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            yield np.unique(run[a : b - k + 1])
        elif b > a:
            whole = mix64(np.array([1000 + b - a], U64))
            for x in h[a:b]:
                whole = mix64(whole ^ x)
            yield whole
        else:
            yield np.zeros(0, U64)


_N = TREES * LEVELS
_XOR = (mix64(np.arange(1, _N + 1, dtype=U64)) >> U64(32)).astype(np.uint32)[:, None]
_MUL = ((mix64(np.arange(1001, _N + 1001, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1))[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of _N hash functions over a set, each reduced to a byte."""
    low = np.full(_N, 0xFFFFFFFF, np.uint32)
    x = (mix64(shingles) >> U64(32)).astype(np.uint32)
    for a in range(0, len(x), 2048):
        np.minimum(low, (((x[None, a : a + 2048] ^ _XOR) * _MUL)).min(axis=1), out=low)
    return (mix64(low) >> U64(56)).astype(np.uint8)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (size of the set), two 64-bit fingerprints of the set, signature."""

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            n, f1, f2, sig = [], [], [], []
            for s in shingle_sets(*text_bytes(b.column("text")), k):
                n.append(len(s))
                f1.append(int(s.sum(dtype=U64).astype(np.int64)))
                f2.append(int(mix64(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).astype(np.int64)))
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n", "f1", "f2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, n long, f1 long, f2 long, sig binary")


def _labels(classes: DataFrame) -> DataFrame:
    """label (tree and LABEL levels), rep and n for each class and tree."""
    order = (np.arange(TREES)[:, None] * LEVELS + np.arange(LABEL)) % _N

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            sig = text_bytes(b.column("sig"))[0].reshape(b.num_rows, _N)
            label = np.empty((b.num_rows, TREES, 1 + LABEL), np.uint8)
            label[:, :, 0] = np.arange(TREES)
            label[:, :, 1:] = sig[:, order]
            row = pa.array(np.repeat(np.arange(b.num_rows), TREES))
            made = pa.FixedSizeBinaryArray.from_buffers(pa.binary(1 + LABEL), b.num_rows * TREES, [None, pa.py_buffer(label.tobytes())])
            yield pa.RecordBatch.from_arrays([made.cast(pa.binary()), b.column("rep").take(row), b.column("n").take(row)], ["label", "rep", "n"])

    return classes.select("rep", "n", "sig").mapInArrow(spread, "label binary, rep long, n long")


def _lead(gid: np.ndarray, rep: np.ndarray, n: np.ndarray, sk: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is to be decided in groups of classes (gid sorted), and which rows led others.

    Of each pair: class, class, matches, whether the first took the second, the leader. In regions that
    were told apart or cut (rows in `split`) only what leaders take is told, as there everyone else asks.
    """
    m = len(gid)
    free = np.ones(m, bool)
    led = np.zeros(m, bool)
    out = []
    rows = np.arange(m)
    start = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
    stop = np.append(start, m)[1:]
    big = stop - start > _SMALL

    def sizes_allow(x: np.ndarray, y: np.ndarray, tenths: int) -> np.ndarray:
        return 10 * np.minimum(n[x], n[y]) >= tenths * np.maximum(n[x], n[y])

    def take(rows: np.ndarray, pivot: np.ndarray) -> None:
        """Compare the free rows given with the pivot of each."""
        same = (sk[rows] == sk[pivot]).sum(axis=1)
        decide = (same >= DECIDE) & sizes_allow(rows, pivot, 8) & (rows != pivot)
        taken = decide & (same >= LOOKS)
        decide &= taken | ~split[rows]
        out.append(np.stack([rep[pivot[decide]], rep[rows[decide]], same[decide], taken[decide].astype(np.int64), rep[pivot[decide]]]))
        free[rows[taken]] = False
        free[pivot] = False
        led[pivot[decide]] = True
        near = (same >= FLAG) & ~taken & sizes_allow(rows, pivot, 6) & (rows != pivot) & ~split[rows] & np.isin(pivot, pivot[taken])
        for p in np.unique(pivot[near]):  # what is near a leader but not taken may be linked to one that it took
            mine, others = rows[taken & (pivot == p)], rows[near & (pivot == p)]
            for i in range(0, len(others), 64):
                some = others[i : i + 64]
                match = (sk[some][:, None, :] == sk[mine][None]).sum(axis=2) * sizes_allow(some[:, None], mine[None], 8)
                best = match.argmax(axis=1)
                top = match[np.arange(len(some)), best]
                good = top >= DECIDE
                out.append(np.stack([rep[mine[best[good]]], rep[some[good]], top[good], np.zeros(int(good.sum()), np.int64), np.full(int(good.sum()), rep[p])]))

    for s, e in zip(start[big], stop[big]):
        while len(left := rows[s:e][free[s:e]]):
            usual = np.array([np.bincount(c, minlength=256).argmax() for c in sk[left].T], np.uint8)
            pivot = left[np.argmax((sk[left] == usual).sum(axis=1))]
            take(left, np.full(len(left), pivot))
    while len(left := rows[free]):
        first = np.concatenate([[True], gid[left][1:] != gid[left][:-1]])
        take(left, left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))])
    return np.concatenate(out, axis=1), led


def _prefixes(label: np.ndarray) -> np.ndarray:
    """The length of the longest common prefix of each row with the one before it."""
    out = np.zeros(len(label), np.int64)
    same = label[1:] == label[:-1]
    out[1:] = np.where(same.all(axis=1), label.shape[1], same.argmin(axis=1))
    return out


def regions(label: np.ndarray, depth: int = DEPTH, most: int = REGION) -> tuple[np.ndarray, np.ndarray]:
    """For sorted labels: the region of each, of `most` rows at most, and whether it took more than `depth` levels.

    A region takes the fewest levels, `depth` at least, at which it is small enough. Equal labels beyond that are dealt
    into runs.
    """
    shared = _prefixes(label)
    start = shared < 1 + depth
    if len(start):
        start[0] = True
    deeper = np.zeros(len(start), bool)
    for d in range(depth, label.shape[1]):
        group = np.cumsum(start) - 1
        big = np.bincount(group, minlength=1)[group] > most
        if not big.any():
            return group, deeper
        deeper |= big
        start |= big & (shared < 2 + d)
    first = np.flatnonzero(start)
    at = np.arange(len(start)) - first[np.cumsum(start) - 1]
    return np.cumsum(start | (at % most == 0)) - 1, deeper


def _at_depth(label: np.ndarray) -> np.ndarray:
    """The number of each row's region of depth DEPTH: its tree and first levels."""
    out = np.zeros(len(label), np.int64)
    for d in range(1 + DEPTH):
        out = out << 8 | label[:, d]
    return out


def _parts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool, bool]]:
    """label, rep, n of sorted rows in pieces of whole regions of DEPTH, about HELD rows, and whether the first or the last
    region of the piece may go on beyond it."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count, open_first = 0, True

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*held))

    for b in batches(it):
        held.append((text_bytes(b.column("label"))[0].reshape(b.num_rows, 1 + LABEL), b.column("rep").to_numpy(), b.column("n").to_numpy()))
        count += b.num_rows
        if count < HELD:
            continue
        label, rep, n = joined()
        own = _at_depth(label)
        last = int(np.searchsorted(own, own[-1]))
        if last == 0:  # one region only
            yield label, rep, n, True, True
            held, count, open_first = [], 0, True
        else:
            yield label[:last], rep[:last], n[:last], open_first, False
            held, count, open_first = [(label[last:], rep[last:], n[last:])], len(label) - last, False
    if held and count:
        yield *joined(), open_first, True


_FOUND = "kind int, a long, b long, same long, taken long, leader long, region long"
_PAIR, _MEMBER = 0, 1


def _find_pairs(labels: DataFrame, parts: int) -> DataFrame:
    """Of each region: pairs (a leads b), and members (a) of the regions of DEPTH that were told apart or cut."""

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, rep, n, before, after in _parts(it):
            own = _at_depth(label)
            group, deeper = regions(label, DEPTH, REGION)
            cut = np.zeros(len(own), bool)
            if before:
                cut |= own == own[0]
            if after:
                cut |= own == own[-1]
            split = np.isin(own, own[deeper]) | cut
            size = np.bincount(group)[group]
            at = np.flatnonzero((size > 1) | split)
            if not len(at):
                continue
            pairs = []
            now, ask = at, group[at]
            while len(now):
                found, leads = _lead(ask, rep[now], n[now], label[now][:, 1 + DEPTH :], split[now])
                pairs.append(found)
                left = now[leads & split[now]]
                if len(left) >= len(now):
                    break
                now = left if deeper[now].any() else left[:0]
                if len(now):  # leaders meet where few enough are left
                    ask, apart = regions(label[now], DEPTH, REGION)
                    deeper = np.zeros(len(own), bool)
                    deeper[now] = apart
            found = np.concatenate(pairs, axis=1)
            member = np.flatnonzero(split)
            m, k = found.shape[1], len(member)
            some = lambda x: pa.array(np.concatenate([x, np.zeros(k, x.dtype)]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([_PAIR, _MEMBER], np.int32), [m, k])),
                    pa.array(np.concatenate([found[0], rep[member]])),
                    *(some(found[i]) for i in range(1, 5)),
                    pa.array(np.concatenate([np.zeros(m, np.int64), own[member]])),
                ],
                [f.split()[0] for f in _FOUND.split(", ")],
            )

    return labels.repartitionByRange(parts, "label", "rep").sortWithinPartitions("label", "rep").mapInArrow(find, _FOUND)


def _decide(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough."""

    def test(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for b in batches(it):
            good = np.zeros(b.num_rows, bool)
            for i, s in enumerate(shingle_sets(*text_bytes(b.column("text_b")), k)):
                one = b.column("text_a").slice(i, 1)
                if one != last:  # rows come sorted by a; its text is sent with each, its set made once
                    last, own = one, next(shingle_sets(*text_bytes(one), k))
                both = len(np.intersect1d(own, s, assume_unique=True))
                good[i] = len(s) > 0 and 100 * both >= percent * (len(own) + len(s) - both)
            yield b.select(["a", "b"]).filter(pa.array(good))

    with_b = pairs.select("a", "b").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    both = with_b.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(test, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    spark = docs.sparkSession
    tables = Tables()
    rows = tables.hold(signatures(docs, k))
    named = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = tables.hold(named.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    total = classes.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * TREES // 400_000))

    found = tables.hold(_find_pairs(_labels(classes), parts))
    columns = ["a", "b", "same", "taken", "leader"]
    pairs = found.where(F.col("kind") == _PAIR).select(*columns).where("a <> b")
    pairs = tables.hold(pairs.groupBy("a", "b", "leader").agg(F.max("same").alias("same"), F.max("taken").alias("taken")))
    in_split = found.where(F.col("kind") == _MEMBER).select("region", F.col("a").alias("rep"))

    own = F.struct("f1", "f2")
    shared = tables.hold(named.groupBy("doc_id").agg(F.min(own).alias("x"), F.max(own).alias("y")).where("x <> y").select("doc_id"))  # ids of different rows

    ends = pairs.select(F.explode(F.array("a", "b", "leader")).alias("rep")).unionAll(in_split.select("rep")).distinct()
    texts = tables.hold(_only(docs.select(F.col("doc_id").cast("long").alias("rep"), "text"), tables.hold(ends)))
    best = tables.hold(pairs.groupBy("b").agg(F.max_by("a", F.struct("same", -F.col("a"))).alias("a")))
    links = tables.hold(_decide(best, texts, k, percent))
    if not shared.isEmpty():
        clash = named.join(shared, "doc_id").join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        links = links.unionByName(tables.hold(clash.where("a <> b")))
    labels = connected_components(links)
    tables.made.append(labels)
    placed = tables.hold(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    reps = placed.select("f1", "f2", F.col("component").alias("component_id"))
    asked = _groups(tables, pairs, placed.select("rep", "component"), in_split)
    if not asked.isEmpty():
        met = tables.hold(_plausible(tables, asked, placed.select("rep", "n", "sig", "component"), percent))
        more = tables.hold(_ask(met, texts, k, percent))
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more))
            tables.made.append(labels)
            reps = classes.select("f1", "f2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    linked = named.select("doc_id", "n", "f1", "f2").join(reps, ["f1", "f2"]).select("doc_id", "n", "component_id")
    lone = rows.where(F.col("doc_id").isNull() | (F.col("n") == 0)).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(lone)
    return tables.result(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts (rep, text) whose rep is in ids. A bitmap of fixed size keeps most other texts from being moved."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP)).cast("int")
    bits = np.zeros(BITMAP, bool)
    bits[ids.select(at("rep").alias("i")).distinct().toPandas()["i"].to_numpy()] = True  # BITMAP rows at most
    sent = texts.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def sift(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value).astype(bool)
        for b in it:
            yield b.filter(pa.array(bits[b.column("i").to_numpy()])).select(["rep", "text"])

    few = texts.where(F.col("rep").isNotNull()).select("rep", "text", at("rep").alias("i")).mapInArrow(sift, "rep long, text string")
    return few.join(ids.hint("merge"), "rep", "left_semi")


def _groups(tables: Tables, pairs: DataFrame, placed: DataFrame, in_split: DataFrame) -> DataFrame:
    """Who asks whom: kind and id of a group, rep, and whether it asks the group or is a member of it. placed: rep, component."""
    of = lambda side: placed.select(F.col("rep").alias(side), F.col("component").alias(f"c_{side}"))
    apart = tables.hold(pairs.join(of("a"), "a").join(of("b"), "b").where("c_a <> c_b").select("b", "taken", "leader", "c_a", "c_b"))
    facing = apart.select(F.greatest("c_a", "c_b").alias("component"), F.least("c_a", "c_b").alias("g")).distinct()

    regions = in_split.join(placed, "rep")
    largest = regions.groupBy("region", "component").agg(F.count("*").alias("m")).groupBy("region").agg(F.max_by("component", F.struct("m", -F.col("component"))).alias("largest"))
    outside = tables.hold(regions.join(largest, "region").where("component <> largest"))

    asks = tables.hold(facing.join(placed, "component").select("g", "rep").unionAll(outside.select(F.col("largest").alias("g"), "rep")))
    members = asks.select(F.col("g").alias("component")).distinct().join(placed, "component").select(F.col("component").alias("g"), "rep")
    failed = apart.where("taken > 0").select(F.col("leader").alias("g"), F.col("b").alias("rep"))
    through = pairs.join(failed.select(F.col("g").alias("leader")).distinct(), "leader", "left_semi").select(F.col("leader").alias("g"), F.explode(F.array("a", "b", "leader")).alias("rep"))
    own = outside.select(F.col("region").alias("g"), "rep")
    out = None
    for kind, asking, being in ((0, asks, members), (1, failed, through), (2, own, own)):
        for df, flag in ((asking, True), (being, False)):
            some = df.select(F.lit(kind).alias("kind"), "g", "rep", F.lit(flag).alias("asks"))
            out = some if out is None else out.unionAll(some)
    return tables.hold(out.distinct())


def _plausible(tables: Tables, asked: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Those who ask and the members they meet, by block, wherever their signatures leave a link open. A group's members are
    dealt into blocks and those who ask into turns; each block sees each turn, as signatures."""
    ask, be = F.count(F.when(F.col("asks"), 1)), F.count(F.when(~F.col("asks"), 1))
    large = asked.groupBy("kind", "g").agg(ask.alias("a"), be.alias("m")).where((F.col("m") > BLOCK) | (F.col("a") > ASKERS))
    large = tables.hold(large.select("kind", "g", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("a") / ASKERS).cast("int").alias("turns")))
    if large.count() <= MOST_LARGE:
        cut = asked.join(F.broadcast(large), ["kind", "g"], "left")
    else:  # a group may have very many rows
        salts = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        cut = asked.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(salts, ["kind", "g", "salt"], "left")
    parts, turns = F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)), F.greatest(F.coalesce("turns", F.lit(1)), F.lit(1))
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    each = lambda n, of: F.transform(F.sequence(F.lit(0), n - 1), of)
    there = F.when(F.col("asks"), each(parts, lambda p: F.struct(p.alias("p"), own(turns).alias("t")))).otherwise(each(turns, lambda t: F.struct(own(parts).alias("p"), t.alias("t"))))
    told = cut.join(placed.hint("merge"), "rep").withColumn("part", F.explode(there))
    least = ASKED * percent // 80

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, wanted = None, [], np.zeros(0, bool)
        rep = component = n = sig = np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(wanted)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now, np.int64)), pa.array(np.zeros(len(at), bool)), pa.array(rep[at]), pa.array(component[at])], ["bucket", "asks", "rep", "component"])

        for b in batches(it):
            key, asks = b.column("bucket").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            own = b.column("rep").to_numpy(), b.column("component").to_numpy(), b.column("n").to_numpy(), text_bytes(b.column("sig"))[0].reshape(b.num_rows, _N)
            edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (asks[1:] != asks[:-1])]))
            for i, j in zip(edges, np.append(edges[1:], len(key))):  # a bucket's members, then those who ask
                if key[i] != now:
                    if wanted.any():
                        yield done()
                    now, members, wanted = key[i], [], np.zeros(0, bool)
                if not asks[i]:
                    members.append(tuple(x[i:j] for x in own))
                    continue
                if members and len(wanted) == 0:
                    rep, component, n, sig = (np.concatenate(x) for x in zip(*members))
                    wanted = np.zeros(len(rep), bool)
                good = np.zeros(j - i, bool)
                for k in range(i, j, 32) if len(wanted) else ():
                    e = min(j, k + 32)
                    n_a = own[2][k:e, None]
                    open_ = (own[1][k:e, None] != component) & (100 * np.minimum(n_a, n) >= percent * np.maximum(n_a, n))
                    if open_.any():
                        open_ &= (own[3][k:e, None, :] == sig[None]).sum(axis=2, dtype=np.int16) >= least
                        good[k - i : e - i] = open_.any(axis=1)
                        wanted |= open_.any(axis=0)
                at = i + np.flatnonzero(good)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(np.ones(len(at), bool)), pa.array(own[0][at]), pa.array(own[1][at])], ["bucket", "asks", "rep", "component"])
        if wanted.any():
            yield done()

    ready = told.select(F.xxhash64("kind", "g", "part.p", "part.t").alias("bucket"), "asks", "rep", "component", "n", "sig")
    many = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return ready.repartition(many, "bucket").sortWithinPartitions("bucket", "asks").mapInArrow(meet, "bucket long, asks boolean, rep long, component long")


def _ask(met: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between those who ask and the members they met in other components, on the full sets: one for each who
    asks, bucket and component."""

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, reps, components, sets = None, True, [], [], []
        hashes = doc = first = sizes = None
        for b in batches(it):
            key, asks = b.column("bucket").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            rep, component = b.column("rep").to_numpy(), b.column("component").to_numpy()
            out: list[tuple[int, int]] = []
            for i, s in enumerate(shingle_sets(*text_bytes(b.column("text")), k)):
                if key[i] != now:
                    now, open_, reps, components, sets = key[i], True, [], [], []
                if not asks[i]:
                    reps.append(rep[i])
                    components.append(component[i])
                    sets.append(s)
                    continue
                if open_:  # members come first: from here on their shingles are an index
                    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
                    sizes = np.array([len(x) for x in sets], np.int64)
                    order = np.argsort(flat, kind="stable")
                    doc = np.repeat(np.arange(len(sets)), sizes)[order]
                    hashes, first = np.unique(flat[order], return_index=True)
                    first = np.append(first, len(flat))
                    labels, open_, sets = np.array(components), False, []
                if not len(hashes) or not len(s):
                    continue
                at = np.searchsorted(hashes, s)
                at = at[(at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == s)]
                n = first[at + 1] - first[at]
                hits = doc[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                both = np.bincount(hits, minlength=len(sizes))
                good = np.flatnonzero((100 * both >= percent * (sizes + len(s) - both)) & (labels != component[i]))
                _, one = np.unique(labels[good], return_index=True)
                out += [(int(reps[j]), int(rep[i])) for j in good[one]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    ready = met.join(texts.hint("merge"), "rep").select("bucket", "asks", "rep", "component", "text")
    many = max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return ready.repartition(many, "bucket").sortWithinPartitions("bucket", "asks").mapInArrow(ask, "a long, b long")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, with its own columns; of rows that repeat doc_id and text, one."""
    kept = near_duplicates(docs, k, percent).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.where(F.col("doc_id").isNotNull())
    once = named.join(kept, named["doc_id"].cast("long") == kept["_kept"], "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(docs.where(F.col("doc_id").isNull()))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT g.doc_id, len(s)::BIGINT AS n_shingles, min(r.b) AS component_id, g.doc_id = min(r.b) AS kept
FROM g JOIN r ON r.a = g.doc_id GROUP BY g.doc_id, len(s)
"""
