"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by k-means that splits what grows too large. Every vector is entered in
the list of its nearest centroid and, if it lies near a boundary, in further lists: those whose centroid is at
most (1 + SPREAD) times as far, REPLICAS at most. Centroids are searched by best-first walks on an in-memory graph
that joins each centroid to its nearest others. A query reads the lists whose centroid is at most `ratio` times
as far as its nearest one; the ratio is fitted on the sample, so that queries find a share REACH of their neighbours. Queries
that so find fewer than k read every list.

Equal vectors are one class with its smallest `k + 1` ids, so that a vector held by a third of all rows is
compared once. Long lists, and the queries of a list that many ask, are cut into parts that different tasks compare.
Beyond LIST * MOST_LISTS vectors lists grow with the table, and a query's work with them; what is broadcast does not.

Cases: vectors that are null, zero, empty, or hold null or non-finite components take no part; nor do those of
another length than the most frequent (of equally frequent ones the shortest). Rows of one vec_id and
vector count once. A query with fewer candidates than k gets them all. No valid
vector, no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Tables, batches, mix64, text_bytes

#: Vectors of a list that centroids are made for, and the most centroids: these and their graph are broadcast.
LIST, MOST_LISTS = 100, 8192
#: Rows of the sample that centroids are fitted on, for each centroid.
SAMPLE = 16
SPREAD, REPLICAS = 0.05, 3
#: Queries of the sample that the pruning ratio is fitted with, and the share of their neighbours in the sample that it must reach.
TRIALS, REACH = 512, 0.93
LINKS = 24
#: Vectors of the sample that bound, for each query, how far its answers can be.
BOUND = 8192
#: Entries of a list, and queries of a list, that one task compares.
PART, ASKING = 4096, 2048
_ROUNDS = 8


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of a and b."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None], 0)


def balanced_centroids(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids of the rows of x, of about equal shares: Lloyd's steps, each moving the least used into the most used."""
    k = max(1, min(k, len(x)))
    order = np.argsort(mix64(np.arange(len(x), dtype=U64)), kind="stable")
    c = x[order[:k]].astype(np.float64)
    for step in range(_ROUNDS):
        near = np.concatenate([_squares(x[i : i + 2048], c).argmin(1) for i in range(0, len(x), 2048)])
        size = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        if step < _ROUNDS - 2:
            heavy = np.argsort(-size, kind="stable")
            light = np.argsort(size, kind="stable")
            for h, s in zip(heavy[: k // 8], light):
                if size[h] <= 2 * len(x) / k or size[h] <= 3 * size[s]:
                    break
                mine = np.flatnonzero(near == h)
                c[s] = x[mine[int(mix64(np.array([step * k + h], U64))[0] % U64(len(mine)))]]
    return c


class CentroidGraph:
    """Centroids, each linked to its nearest others and a few far ones, and best-first search among them."""

    def __init__(self, centroids: np.ndarray, scale: float = 0.0):
        """scale: a usual distance to the nearest centroid; ratios are taken to no less, as a vector may be a centroid itself."""
        self.c, self.scale = np.ascontiguousarray(centroids, np.float64), scale
        k = len(self.c)
        m = min(LINKS, k - 1)
        near = np.zeros((k, m), np.int32)
        for i in range(0, k, 1024):
            d = _squares(self.c[i : i + 1024], self.c)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i : i + 1024] = np.argpartition(d, m - 1, axis=1)[:, :m] if m else 0
        far = (mix64(np.arange(k * 4, dtype=U64) + U64(99)) % U64(k)).astype(np.int32).reshape(k, 4)
        self.links = np.concatenate([near, far], 1)
        self.ratio, self.width, self.near = 1.0, 1, self.c[:0]
        self.entry = (np.arange(min(k, 16)) * (k / min(k, 16))).astype(int)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q, up to `width` near centroids (-1: none) and their distances, nearest first."""
        width = min(width, len(self.c))
        ids, dist = [], []
        for i in range(0, len(q), 256):
            a, b = self._walk(q[i : i + 256], width)
            ids.append(a)
            dist.append(b)
        return np.concatenate(ids), np.concatenate(dist)

    def _walk(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(q)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, len(self.c)), bool)
        first = np.broadcast_to(self.entry, (n, len(self.entry)))
        seen[rows, first] = True
        best = first.astype(np.int32)
        dist = _squares(q, self.c[self.entry])
        open_ = np.ones(best.shape, bool)
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :width]
            best, dist, open_ = best[rows, order], dist[rows, order], open_[rows, order]
            go = np.where(open_, dist, np.inf)
            pick = go.argmin(1)
            alive = np.isfinite(go[np.arange(n), pick])
            if not alive.any():
                break
            at = np.flatnonzero(alive)
            open_[at, pick[at]] = False
            nxt = self.links[best[at, pick[at]]]
            nxt = np.sort(nxt, axis=1)
            fresh = ~seen[at[:, None], nxt]
            fresh[:, 1:] &= nxt[:, 1:] != nxt[:, :-1]
            seen[at[:, None], nxt] = True
            diff = self.c[nxt] - q[at][:, None, :]
            d = np.where(fresh, np.einsum("ijk,ijk->ij", diff, diff), np.inf)
            more = np.full((n, nxt.shape[1]), -1, np.int32)
            more_d = np.full((n, nxt.shape[1]), np.inf)
            more[at], more_d[at] = nxt, d
            best = np.concatenate([best, more], 1)
            dist = np.concatenate([dist, more_d], 1)
            open_ = np.concatenate([open_, np.isfinite(more_d)], 1)
        return np.where(np.isfinite(dist), best, -1), np.sqrt(dist)

    def entries(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists that vectors are entered in."""
        ids, dist = self.search(x, 4 * REPLICAS)
        near = (ids >= 0) & (dist <= (1 + SPREAD) * np.maximum(dist[:, :1], self.scale))
        row, j = np.nonzero(near[:, :REPLICAS])
        return row, ids[row, j]

    def fit_pruning(self, x: np.ndarray, k: int) -> None:
        """Set the ratio, and the width of walks, by queries of the sample x and their k nearest in it."""
        self.near = x[:BOUND]
        q = x[:TRIALS]
        d = _squares(q, x)
        d[np.arange(len(q)), np.arange(len(q))] = np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return
        true = np.argpartition(d, k - 1, axis=1)[:, :k]
        to = np.sqrt(_squares(q, self.c))
        to /= np.maximum(to.min(axis=1, keepdims=True), self.scale)
        row, at = self.entries(x)
        own = np.full((len(x), REPLICAS), -1)
        slot = np.arange(len(row)) - np.searchsorted(row, row)
        own[row, slot] = at
        lists = own[true]
        need = np.where(lists >= 0, to[np.arange(len(q))[:, None, None], lists], np.inf).min(axis=2)
        self.ratio = float(np.quantile(need, REACH))
        self.width = int(min(len(self.c), np.quantile((to <= self.ratio).sum(axis=1), 0.99) + LINKS))

    def bounds(self, q: np.ndarray, k: int) -> np.ndarray:
        """For each query, a distance within which k indexed vectors lie: that of its k-th nearest in the sample."""
        if len(self.near) < k:
            return np.full(len(q), np.inf)
        return np.concatenate([np.sqrt(np.partition(_squares(q[i : i + 256], self.near), k - 1, axis=1)[:, k - 1]) for i in range(0, len(q), 256)]) * (1 + 1e-6) + 1e-6

    def probes(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that queries read; walks are widened until they pass the ratio."""
        ids, dist = self.search(q, self.width)
        limit = self.ratio * np.maximum(dist[:, :1], self.scale)
        short = np.flatnonzero((dist[:, -1:] <= limit)[:, 0]) if ids.shape[1] < len(self.c) else []
        keep = np.ones(len(q), bool)
        keep[short] = False
        row, j = np.nonzero((ids >= 0) & (dist <= limit) & keep[:, None])
        found = [(row, ids[row, j])]
        if len(short):
            all_d = np.sqrt(_squares(q[short], self.c))
            r, j = np.nonzero(all_d <= limit[short])
            found.append((np.asarray(short)[r], j))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _valid(e: Column) -> Column:
    x = F.transform(e, lambda v: v.cast("double"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return e.isNotNull() & (F.size(e) > 0) & F.forall(x, finite) & F.exists(x, lambda v: v != 0)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(text_bytes(column)[0].tobytes(), "<f8").reshape(len(column), dim)


_SEARCH = "query_id long, rank int, vec_id long, score double"


def nearest(table: DataFrame, query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row of table (vec_id, embedding) that `query` selects."""
    spark, tables = table.sparkSession, Tables()
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: v.cast("double")).alias("e"), query.alias("asks")).where(_valid(F.col("e")) & F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], _SEARCH)
    dim = sizes[0]["d"]
    hashed = rows.where(F.size("e") == dim).select("vec_id", "e", "asks", F.xxhash64("e").alias("k1"), F.xxhash64(F.lit(1), "e").alias("k2"))
    once = hashed.groupBy("k1", "k2", "vec_id").agg(F.first("e").alias("e"), F.max("asks").alias("asks"))

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            v = b.column("e").flatten().to_numpy().reshape(b.num_rows, dim)
            names = [c for c in b.schema.names if c != "e"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([x.tobytes() for x in v], pa.binary())], [*names, "v"])

    once = tables.hold(once.select("k1", "k2", "vec_id", "asks", "e").mapInArrow(packed, "k1 long, k2 long, vec_id long, asks boolean, v binary"))
    rank = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    members = tables.hold(once.select("k1", "k2", "vec_id").withColumn("r", rank).where(F.col("r") <= k + 1))
    first = members.where("r = 1").select("k1", "k2", "vec_id")
    classes = tables.hold(once.join(first, ["k1", "k2", "vec_id"]).select("k1", "k2", F.col("vec_id").alias("rep"), "v"))
    n = classes.count()

    lists = max(1, min(MOST_LISTS, n // LIST))
    share = min(1.0, SAMPLE * lists / n)
    some = classes.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE * lists).select("k1", "k2", "v").toPandas().sort_values(["k1", "k2"])
    if some.empty:
        some = classes.limit(1).toPandas()
    sample = np.frombuffer(b"".join(some["v"]), "<f8").reshape(-1, dim)
    centroids = balanced_centroids(sample, lists)
    scale = float(np.median(np.concatenate([_squares(sample[i : i + 2048], centroids).min(1) for i in range(0, len(sample), 2048)]) ** 0.5))
    graph = CentroidGraph(centroids, scale)
    graph.fit_pruning(sample, k)
    sent = spark.sparkContext.broadcast(graph)  # MOST_LISTS rows at most

    def enter(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            row, at = sent.value.entries(_vectors(b.column("v"), dim))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(b.column(c).take(pa.array(row)) for c in ("rep", "v"))], ["list", "rep", "v"])

    def probe(every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The lists that queries read, by the ratio or all."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches(it):
                v, n = _vectors(b.column("v"), dim), len(sent.value.c)
                row, at = np.divmod(np.arange(len(v) * n), n) if every else sent.value.probes(v)
                bound = sent.value.bounds(v, k + 1)[row]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(b.column(c).take(pa.array(row)) for c in ("q", "v")), pa.array(bound)], ["list", "q", "v", "bound"])

        return run

    postings = tables.hold(classes.select("rep", "v").mapInArrow(enter, "list int, rep long, v binary"))
    parts = postings.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))  # a row a list
    asking = once.where("asks").select("k1", "k2").distinct().join(classes, ["k1", "k2"]).select(F.col("rep").alias("q"), "v")

    def compare(key: object, left: pa.Table, right: pa.Table) -> pa.Table:
        own, asked = [], []
        if left.num_rows and right.num_rows:
            rep, names, bounds = left.column("rep").to_numpy(), right.column("q").to_numpy(), right.column("bound").to_numpy()
            v, q = (_vectors(t.column("v").combine_chunks(), dim) for t in (left, right))
            for i in range(0, len(q), 256):
                reach = bounds[i : i + 256, None] ** 2
                rough = _squares(q[i : i + 256], v)  # of a rounding error far below the margin
                margin = 1e-9 * ((q[i : i + 256] ** 2).sum(1)[:, None] + (v * v).sum(1)[None])
                row, at = np.nonzero(rough <= reach + margin)
                diff = v[at] - q[i + row]
                d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                order = np.lexsort((rep[at], d, row))
                row, at, d = row[order], at[order], d[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                top = (place <= k) & (d <= bounds[i + row])
                own.append((rep[at[top]], d[top]))
                asked.append(names[i + row[top]])
        rep, d = (np.concatenate(x) for x in zip(*own)) if own else (np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"q": pa.array(np.concatenate(asked) if asked else np.zeros(0, np.int64)), "rep": pa.array(rep), "score": pa.array(d)})

    # back from classes to rows: q and rep are the smallest ids of their classes; ids may repeat, so classes are joined by hash
    ids = classes.select("k1", "k2", F.col("rep"))
    top = F.row_number().over(Window.partitionBy("q").orderBy("score", "rep"))
    best = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))

    def found_in(queries: DataFrame, every: bool) -> DataFrame:
        """q, score, vec_id of the k + 1 nearest rows in the lists read."""
        probing = tables.hold(queries.mapInArrow(probe(every), "list int, q long, v binary, bound double"))
        asks = probing.groupBy("list").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("asking"))  # a row a list
        cut = F.broadcast(parts.join(asks, "list"))  # MOST_LISTS rows at most
        both = lambda n, mine: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(mine)
        dealt = lambda key, n, mine: F.pmod(F.xxhash64(key), F.col(n)).cast("int").alias(mine)
        entered = postings.join(cut, "list").select("list", dealt("rep", "parts", "part"), both("asking", "ask"), "rep", "v")
        probing = probing.join(cut, "list").select("list", both("parts", "part"), dealt("q", "asking", "ask"), "q", "v", "bound")
        keys = ["list", "part", "ask"]
        hits = entered.groupBy(*keys).cogroup(probing.groupBy(*keys)).applyInArrow(compare, "q long, rep long, score double")
        hits = hits.groupBy("q", "rep").agg(F.min("score").alias("score")).withColumn("r", top).where(F.col("r") <= k + 1).drop("r")
        rows = hits.join(ids, "rep").join(members.drop("r"), ["k1", "k2"]).select("q", "score", "vec_id")
        return rows.groupBy("q", "vec_id").agg(F.min("score").alias("score")).withColumn("r", best).where(F.col("r") <= k + 1).drop("r")

    found = tables.hold(found_in(asking, False))
    full = found.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") > k)  # one of the k + 1 is the query itself
    lacking = tables.hold(asking.join(full.select("q"), "q", "left_anti"))
    if not lacking.isEmpty():
        found = found.join(lacking.select("q"), "q", "left_anti").unionByName(found_in(lacking, True))  # MOST_LISTS probes a query at most
    answers = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))  # k + 1 a query
    answers = answers.join(ids.withColumnRenamed("rep", "q"), "q").select("k1", "k2", "near", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    asks = once.where("asks").select("k1", "k2", F.col("vec_id").alias("query_id"), F.pmod(F.xxhash64("vec_id"), F.lit(16)).cast("int").alias("salt"))
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asks.join(answers, ["k1", "k2", "salt"]).select("query_id", F.posexplode(own).alias("at", "x"))
    return tables.result(out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")))
