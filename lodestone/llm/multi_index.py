"""Approximate nearest neighbours (largest inner product) by an inverted multi-index.

The two halves of a vector are quantised apart, each by its own codebook of
``CENTROIDS``; a row's cell is the pair of its centroids.  A query visits pairs
in the order of their summed distance with a heap, until the cells visited hold
``share`` of all rows (``LEAST`` rows at least), and the entries of these cells
are ranked by their inner product in double precision.

Codebooks are fitted by k-means on at most ``SAMPLE_ROWS`` rows, taken by a hash
of their id; every row is indexed.  Nearness is an inner product, so the distance of a
half is ``-(query . centroid + REACH * |query| * radius / sqrt(dimensions))``: what a
row of the cell may add beyond its centroid, which tells where long vectors are.
``share`` is the smallest of ``SHARES`` that finds ``AIM`` of the nearest within the
sample, for up to ``SAMPLE_QUERIES`` of its rows, or the largest.  Cells are packed into shards of about
``SHARD_ROWS`` rows; a larger cell is split over several by a hash of the id, so
one very common vector fills no single task.  A query goes only to shards with a
cell that it visits.  The entries of a shard are repeated only where more than
``QUERY_ROWS`` queries visit it, once for each block of so many.  Each shard gives
its 20 best entries of a query, and a window over these few gives the result.

Recall depends on ``share`` and on how clustered the vectors are.  Vectors without
clusters need the largest share: no index of this kind does with much less than
half of the rows there.

Rows whose vector is null, zero or holds a null or non-finite component, whose id
is null, or whose length is not the commonest take no part.  Of rows that repeat
an id, the one with the smallest vector counts.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, checked_broadcast

CENTROIDS = 64
SAMPLE_ROWS = 16_384
SHARES, LEAST = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6), 200
AIM, SAMPLE_QUERIES, REACH = 0.98, 200, 3.0
SHARD_ROWS, QUERY_ROWS = 8_192, 8_192


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of at most ``k`` clusters; a centroid that loses all points stays where it is."""
    rng = np.random.default_rng(seed)
    centres = np.unique(points, axis=0)
    centres = centres[np.sort(rng.permutation(len(centres))[:k])]
    for _ in range(rounds):
        nearest = assign(points, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        for j in np.flatnonzero(counts):
            centres[j] = points[nearest == j].mean(0)
    return centres


def assign(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in the order of ``first[i] + second[j]`` until they hold ``wanted`` rows; counts is by cell."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    fa, sb, n = first[a].tolist(), second[b].tolist(), len(second)
    a, b = a.tolist(), b.tolist()
    heap, cells, got = [(fa[0] + sb[0], 0, 0)], [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * n + b[j]
        if counts[cell]:
            cells.append(cell)
            got += counts[cell]
        if j + 1 < n:
            heapq.heappush(heap, (fa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(fa):  # each pair is reached once: along j, and along i where j is 0
            heapq.heappush(heap, (fa[i + 1] + sb[0], i + 1, 0))
    return cells


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


class MultiIndex:
    """Codebooks, counts by cell, and where cells lie; all of fixed size but for one shard number a shard."""

    def __init__(self, sample: np.ndarray, centroids: int):
        self.half = max(1, sample.shape[1] // 2)
        self.books = k_means(sample[:, : self.half], centroids), k_means(sample[:, self.half :], centroids)
        self.n = len(self.books[1])
        self.radii = self._radii(sample[:, : self.half], self.books[0]), self._radii(sample[:, self.half :], self.books[1])
        self.counts = np.zeros(len(self.books[0]) * self.n, np.int64)

    @staticmethod
    def _radii(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Of each centroid the root mean square distance of its points, over the root of the dimensions."""
        nearest = assign(points, centres)
        squares = np.bincount(nearest, weights=((points - centres[nearest]) ** 2).sum(1), minlength=len(centres))
        return np.sqrt(squares / np.maximum(1, np.bincount(nearest, minlength=len(centres))) / max(1, points.shape[1]))

    def cells(self, points: np.ndarray) -> np.ndarray:
        return assign(points[:, : self.half], self.books[0]) * self.n + assign(points[:, self.half :], self.books[1])

    def pack(self, shard_rows: int) -> None:
        """Consecutive cells share a shard; a cell with more rows than a shard gets several of its own."""
        self.first, self.parts = np.zeros(len(self.counts), np.int64), np.ones(len(self.counts), np.int64)
        shard, filled = 0, 0
        for cell, count in enumerate(self.counts.tolist()):
            if filled and filled + count > shard_rows:
                shard, filled = shard + 1, 0
            self.first[cell] = shard
            self.parts[cell] = max(1, -(-count // shard_rows))
            filled += count
            if self.parts[cell] > 1:
                shard, filled = shard + int(self.parts[cell]), 0

    def visited(self, query: np.ndarray, wanted: int) -> list[int]:
        halves = query[: self.half], query[self.half :]
        first, second = (-(book @ half + REACH * np.linalg.norm(half) * radii) for book, half, radii in zip(self.books, halves, self.radii, strict=True))
        return visit(first, second, self.counts, wanted)

    def share_for(self, sample: np.ndarray, k: int) -> float:
        """The smallest share that finds AIM of the ``k`` nearest within the sample, or the largest there is."""
        cells = self.cells(sample)
        trial = MultiIndex.__new__(MultiIndex)
        trial.__dict__ |= self.__dict__ | {"counts": np.bincount(cells, minlength=len(self.counts))}
        rows = np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))
        found = np.zeros(len(SHARES))
        for row in rows.tolist():
            score = sample @ sample[row]
            score[row] = -np.inf
            near = cells[np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]]
            place = {c: i for i, c in enumerate(trial.visited(sample[row], len(sample)))}
            reached = np.cumsum(trial.counts[list(place)])  # rows seen after each cell
            before = np.array([reached[place[c]] - trial.counts[c] for c in near])
            found += [(before < max(LEAST, share * len(sample))).mean() if len(near) else 1.0 for share in SHARES]
        good = np.flatnonzero(found / max(1, len(rows)) >= AIM)
        return SHARES[good[0]] if len(good) else SHARES[-1]

    def route(self, query: np.ndarray, wanted: int) -> dict[int, list[int]]:
        """The cells to visit, by shard."""
        shards: dict[int, list[int]] = {}
        for cell in self.visited(query, wanted):
            for shard in range(self.first[cell], self.first[cell] + self.parts[cell]):
                shards.setdefault(int(shard), []).append(cell)
        return shards


def best(ids: np.ndarray, cells: np.ndarray, points: np.ndarray, query_id: int, query: np.ndarray, rough: np.ndarray, visited: list[int], k: int) -> list[tuple]:
    """The ``k`` best entries of the visited cells: exact inner products, ties to the smaller id."""
    open_ = np.isin(cells, visited) & (ids != query_id)
    rough = np.where(open_, rough, -np.inf)
    n = int(open_.sum())
    if n > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        open_ = rough >= least - 1e-9 * max(1.0, abs(least))
    at = np.flatnonzero(open_)
    # Summed along the row, alike for every row: equal vectors get equal scores.
    score = (points[at] * query).sum(1)
    order = np.lexsort((ids[at], -score))[:k]
    return [(query_id, int(ids[at[o]]), float(score[o])) for o in order]


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, share: float | None = None, least: int = LEAST, centroids: int = CENTROIDS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "multi-index")
    rows = scratch.table(usable(vectors, id_col, vector_col), "rows")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == lengths["n"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toPandas()
    known = np.stack(sample["v"].to_numpy())
    index = MultiIndex(known, centroids)
    share = index.share_for(known, k) if share is None else share

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=index.cells(np.stack(batch["v"].to_numpy())).astype("int32"))

    cells = scratch.table(rows.mapInPandas(placed, "vec_id long, v array<double>, cell int"), "cells")
    total = 0
    for row in cells.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        index.counts[row["cell"]] = row["count"]
        total += row["count"]
    index.pack(SHARD_ROWS)
    wanted = max(least, int(np.ceil(share * total)))
    asked = rows.where(F.col("vec_id") % every == 0)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(shard, q, v, c) for q, v in zip(batch["vec_id"], batch["v"], strict=True) for shard, c in index.route(v, wanted).items()]
            yield pd.DataFrame(out, columns=["shard", "query_id", "v", "visited"])

    def array(numbers: np.ndarray) -> F.Column:
        return F.from_json(F.lit(str(numbers.tolist())), "array<int>")  # folded to one literal

    shard = F.element_at(array(index.first), F.col("cell") + 1) + F.pmod(F.xxhash64("vec_id"), F.element_at(array(index.parts), F.col("cell") + 1)).cast("int")
    visits = scratch.table(asked.repartition("vec_id").mapInPandas(routed, "shard int, query_id long, v array<double>, visited array<int>"), "visits")
    loads = visits.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    loads = scratch.table(loads, "loads")
    entries = cells.select(shard.alias("shard"), "vec_id", "cell", "v").join(checked_broadcast(loads), "shard")
    entries = entries.select("shard", "vec_id", "cell", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    loads = loads.select(F.col("shard").alias("s"), F.col("blocks").alias("n"))
    queries = visits.join(checked_broadcast(loads), F.col("shard") == F.col("s"))
    queries = queries.select("shard", "query_id", visits["v"], "visited", F.pmod(F.xxhash64("query_id"), F.col("n")).cast("int").alias("block"))

    def ranked(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asking):
            ids, places, points = own["vec_id"].to_numpy(), own["cell"].to_numpy(), np.stack(own["v"].to_numpy())
            asking_v = np.stack(asking["v"].to_numpy())
            for lo in range(0, len(asking), 128):
                rough = asking_v[lo : lo + 128] @ points.T
                for i, (q, visited) in enumerate(zip(asking["query_id"].iloc[lo : lo + 128], asking["visited"].iloc[lo : lo + 128], strict=True)):
                    out += best(ids, places, points, int(q), asking_v[lo + i], rough[i], visited, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    local = entries.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(ranked, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
