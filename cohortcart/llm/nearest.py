"""Approximate nearest neighbours by inner product, over balanced posting lists.

Equal vectors are merged first; each distinct vector keeps its ``k + 1`` smallest ids, all that can
ever be among the ``k`` nearest of anything, so no count of copies makes a list longer.  A balanced
k-means over a bounded sample gives centroids.  Every distinct vector is put on the list of its
nearest centroid and, near a boundary, on up to ``replicas`` lists whose centroids are nearly as
close.  Centroids are found by best-first search in a neighbour graph that every task holds in
memory.  A query reads the lists whose centroid distance is within a ratio of the nearest one's,
up to a number of lists; both bounds are set so that a sample of queries, answered by brute force
over all vectors, finds ``recall`` of its neighbours.  Lists and their queries are cut into parts of
bounded size, so a crowded list is many tasks' work.

Inner product becomes distance by one more component that gives all vectors the largest norm.
Scores are sums of double products in component order, so equal vectors score alike and ties go to
the smaller id.

Defined cases: null vectors, null or non-finite components, zero vectors and vectors of another
length than most take no part, as queries or candidates; a null ``vec_id`` takes no part; rows that
repeat an id and vector are one candidate, while equal ids with different vectors are ranked by
their best score; fewer candidates than ``k`` are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcart.session import stored


@dataclass(frozen=True)
class IndexSettings:
    """``sample`` bounds the vectors that centroids are fitted on, ``max_lists`` the centroids, and
    ``tuning_queries`` the queries that are also answered by brute force."""

    list_size: int = 1000
    max_lists: int = 2048
    sample: int = 20_000
    replicas: int = 4
    closeness: float = 1.1
    degree: int = 16
    recall: float = 0.97
    tuning_queries: int = 200
    part_rows: int = 8192
    part_queries: int = 4096
    seed: int = 3


# -- centroids and their graph ------------------------------------------------------------------

def balanced_centroids(x: np.ndarray, lists: int, seed: int, rounds: int = 12) -> np.ndarray:
    """K-means in which crowded centroids look farther away, so their borders move in."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), lists, replace=False)].copy()
    penalty, scale = np.zeros(lists), float(x.var(axis=0).sum()) or 1.0
    for _ in range(rounds):
        own = np.concatenate([np.argmin(_distances(block, centres) + penalty, axis=1)
                              for block in np.array_split(x, -(-len(x) // 4096))])
        counts = np.bincount(own, minlength=lists)
        penalty += 0.02 * scale * (counts / counts.mean() - 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, never below zero."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


class CentroidGraph:
    """Centroids with links to their nearest others and back; searched best first, many at a time."""

    def __init__(self, centres: np.ndarray, degree: int):
        self.centres = centres
        n = len(centres)
        d = _distances(centres, centres)
        np.fill_diagonal(d, np.inf)
        nearest = np.argsort(d, axis=1)[:, :min(degree, n - 1)] if n > 1 else np.zeros((1, 0), dtype=int)
        links = [set(row) for row in nearest.tolist()]
        for i, row in enumerate(nearest.tolist()):
            for j in row:
                if len(links[j]) < 2 * degree:
                    links[j].add(i)
        links = self._joined(links, d)
        width = max(map(len, links), default=0)
        self.links = np.array([sorted(s) + [i] * (width - len(s)) for i, s in enumerate(links)], dtype=np.int64)
        self.starts = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))

    @staticmethod
    def _joined(links: list[set], d: np.ndarray) -> list[set]:
        """Adds links until every centroid can be reached from the first."""
        seen, todo = {0}, [0]
        while len(seen) < len(links):
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += list(new)
            if len(seen) < len(links):
                rest = [i for i in range(len(links)) if i not in seen]
                have = sorted(seen)
                i, j = np.unravel_index(np.argmin(d[np.ix_(have, rest)]), (len(have), len(rest)))
                links[have[i]].add(rest[j])
                links[rest[j]].add(have[i])
                seen.add(rest[j])
                todo.append(rest[j])
        return links

    def search(self, x: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids of each row: their numbers and distances, nearest first."""
        n, wanted = len(self.centres), min(wanted, len(self.centres))
        pool = min(n, wanted + 24)
        rows = np.arange(len(x))
        seen = np.zeros((len(x), n), dtype=bool)
        seen[:, self.starts] = True
        ids = np.tile(self.starts, (len(x), 1))
        near = _distances(x, self.centres[self.starts])
        done = np.zeros_like(near, dtype=bool)
        norms = (x * x).sum(1)
        own = (self.centres * self.centres).sum(1)
        while True:
            open_ = np.where(done, np.inf, near)
            at = np.argmin(open_, axis=1)
            if not np.isfinite(open_[rows, at]).any():
                break
            done[rows, at] = True
            new = self.links[ids[rows, at]]
            fresh = ~seen[rows[:, None], new] & np.isfinite(open_[rows, at])[:, None]
            seen[rows[:, None], new] |= fresh
            d = norms[:, None] - 2 * np.einsum("rkd,rd->rk", self.centres[new], x) + own[new]
            d = np.where(fresh, np.maximum(d, 0), np.inf)
            ids, near = np.hstack([ids, new]), np.hstack([near, d])
            done = np.hstack([done, ~fresh])
            if near.shape[1] > pool:
                keep = np.argpartition(near, pool - 1, axis=1)[:, :pool]
                ids, near, done = (np.take_along_axis(a, keep, axis=1) for a in (ids, near, done))
                done |= ~np.isfinite(near)
        order = np.argsort(near, axis=1, kind="stable")[:, :wanted]
        return np.take_along_axis(ids, order, axis=1), np.sqrt(np.take_along_axis(near, order, axis=1))


# -- vectors ------------------------------------------------------------------------------------

def sound(vector: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _lifted(x: np.ndarray, top: float | None) -> np.ndarray:
    """One more component: what is missing to the largest norm (``top`` given), or 0 for queries."""
    last = np.zeros(len(x)) if top is None else np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))
    return np.hstack([x, last[:, None]])


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in component order."""
    total = np.zeros(len(q))
    for k in range(q.shape[1]):
        total += q[:, k] * x[:, k]
    return total


def _best(q_ids: np.ndarray, q: np.ndarray, x: np.ndarray, id_lists, k: int):
    """``(query, vec_id, score)`` arrays: for every query its ``k`` nearest among ``x``, ties kept."""
    outs = []
    offsets = id_lists.offsets.to_numpy()
    flat = id_lists.values.to_numpy(zero_copy_only=False)
    for low in range(0, len(q), max(1, 2_000_000 // max(len(x), 1))):
        block = q[low:low + max(1, 2_000_000 // max(len(x), 1))]
        rough = block @ x.T
        if x.shape[0] > k + 1:
            floor = -np.partition(-rough, k, axis=1)[:, k]
            slack = 1e-9 * (np.abs(block).sum(1) * np.abs(x).max())
            rows, cols = np.nonzero(rough >= (floor - slack)[:, None])
        else:
            rows, cols = (a.ravel() for a in np.indices(rough.shape))
        score = _exact(block[rows], x[cols])
        sizes = offsets[cols + 1] - offsets[cols]
        rows, score = np.repeat(rows, sizes), np.repeat(score, sizes)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = flat[np.repeat(offsets[cols], sizes) + place]
        mine = q_ids[low + rows]
        keep = ids != mine
        mine, ids, score = mine[keep], ids[keep], score[keep]
        order = np.lexsort((ids, -score, mine))
        mine, ids, score = mine[order], ids[order], score[order]
        first = np.r_[True, mine[1:] != mine[:-1]] if len(mine) else np.zeros(0, dtype=bool)
        rank = np.arange(len(mine)) - np.maximum.accumulate(np.where(first, np.arange(len(mine)), 0))
        outs.append((mine[rank < k], ids[rank < k], score[rank < k]))
    return [np.concatenate([o[i] for o in outs]) for i in range(3)]


HITS = "query_id long, vec_id long, score double"


def _hits(arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["query_id", "vec_id", "score"])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of all hits of each query; a vector found on several lists counts once."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    some = hits.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k)
    best = some.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def by_brute_force(points: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The exact answer for a bounded set of queries, block by block over all points."""
    shared = points.sparkSession.sparkContext.broadcast((q_ids, q))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in batches:
            if batch.num_rows and len(ids):
                yield _hits(_best(ids, vectors, _matrix(batch.column(0), vectors.shape[1]), batch.column(1), k))

    return _ranked(points.select("vector", "ids").mapInArrow(nearest, HITS), k)


# -- index and search ---------------------------------------------------------------------------

def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``vector, ids``: every distinct vector with its ``k + 1`` smallest ids."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    first = rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def nearest_neighbours(table: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding",
                       settings: IndexSettings = IndexSettings()) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every sound row that ``is_query`` its ``k`` nearest others.

    Every sound row is indexed; the search is approximate in which lists it reads only."""
    spark, s = table.sparkSession, settings
    kind = table.schema[vector].dataType.simpleString()
    rows = table.where(F.col("vec_id").isNotNull() & sound(F.col(vector))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("asked"))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = lengths["d"]
    rows = rows.where(F.size("vector") == d)
    queries = stored(rows.where("asked").select("vec_id", "vector").distinct(), "queries")
    points = stored(distinct_vectors(rows.select("vec_id", "vector"), k), "points")
    n, top = points.agg(F.count(F.lit(1)), F.max(F.aggregate(
        "vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    top = float(np.sqrt(top))

    def bounded(frame: DataFrame, by: Column, at_most: int, *columns: str):
        return frame.orderBy(by, columns[0]).limit(at_most).select(*columns).toArrow()

    sample = bounded(points, F.xxhash64("vector"), s.sample, "vector")
    x = _lifted(_matrix(sample.column("vector"), d), top)
    lists = max(1, min(s.max_lists, n // s.list_size, len(x)))
    graph = CentroidGraph(balanced_centroids(x, lists, s.seed), s.degree)
    shared = spark.sparkContext.broadcast(graph)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                at, far = shared.value.search(_lifted(_matrix(part.column(0), d), top), s.replicas)
                take = far <= s.closeness * far[:, :1] + 1e-12
                take[:, 0] = True
                r, c = np.nonzero(take)
                picked = part.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(at[r, c])] + picked.columns, names=["list", "vector", "ids"])

    postings = stored(points.select("vector", "ids").mapInArrow(posted, f"list long, vector {kind}, ids array<bigint>"),
                      "postings")
    sizes = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}
    size = np.array([sizes.get(i, 0) for i in range(lists)])

    # how many lists, and how much farther than the nearest: from queries answered by brute force
    tuned = bounded(queries, F.xxhash64("vec_id"), s.tuning_queries, "vec_id", "vector")
    probes, ratio = 1, 1.0
    if tuned.num_rows and lists > 1:
        t_ids, t = tuned.column("vec_id").to_numpy(), _matrix(tuned.column("vector"), d)
        truth = by_brute_force(points, t_ids, t, k).select("query_id", "vec_id")
        on = postings.select("list", F.explode("ids").alias("vec_id")).join(F.broadcast(truth), "vec_id").select(
            "query_id", "vec_id", "list").collect()
        at, far = graph.search(_lifted(t, None), lists)
        place = {(q, c): i for q, cs in zip(t_ids.tolist(), at.tolist(), strict=True) for i, c in enumerate(cs)}
        row = {q: i for i, q in enumerate(t_ids.tolist())}
        need: dict[tuple, int] = {}
        for r in on:
            i = place.get((r["query_id"], r["list"]), lists - 1)
            need[r["query_id"], r["vec_id"]] = min(need.get((r["query_id"], r["vec_id"]), lists), i)
        if need:
            half = (1 + s.recall) / 2
            probes = int(np.quantile(list(need.values()), half, method="higher")) + 1
            ratio = float(np.quantile([far[row[q], i] / max(far[row[q], 0], 1e-12) for (q, _), i in need.items()],
                                      half, method="higher"))
    enough = s.replicas * (k + 1)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                at, far = shared.value.search(_lifted(_matrix(part.column(1), d), None), max(probes, min(lists, 8)))
                read = (np.arange(at.shape[1]) < probes) & (far <= ratio * far[:, :1] + 1e-9)
                read |= np.cumsum(size[at], axis=1) - size[at] < enough
                r, c = np.nonzero(read)
                yield pa.RecordBatch.from_arrays([pa.array(at[r, c])] + part.take(pa.array(r)).columns,
                                                 names=["list", "vec_id", "vector"])

    routes = stored(queries.select("vec_id", "vector").mapInArrow(routed, f"list long, vec_id long, vector {kind}"),
                    "routes")
    asked = routes.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    cuts = spark.createDataFrame([(i, int(-(-size[i] // s.part_rows))) for i in range(lists)], "list long, parts int")
    cuts = cuts.join(asked, "list").select("list", "parts", F.ceil(F.col("n") / s.part_queries).alias("q_parts"))
    cuts = F.broadcast(cuts)      # one row per list
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts).cast("long") - 1))
    left = (routes.join(cuts, "list").withColumn("q_part", F.pmod(F.xxhash64("vec_id"), "q_parts"))
            .withColumn("part", every("parts")).select("list", "part", "q_part", "vec_id", "vector"))
    right = (postings.join(cuts, "list").withColumn("part", F.pmod(F.xxhash64("vector"), "parts"))
             .withColumn("q_part", every("q_parts")).select("list", "part", "q_part", "vector", "ids"))

    def compared(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.Table.from_batches([_hits([np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)])])
        return pa.Table.from_batches([_hits(_best(
            q.column("vec_id").to_numpy(), _matrix(q.column("vector"), d), _matrix(x.column("vector"), d),
            x.column("ids").combine_chunks(), k))])

    keys = ["list", "part", "q_part"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compared, HITS)
    return _ranked(hits, k)
