"""Approximate nearest neighbours by collision counting: sorted arrays of single projections, windows around the query that
virtual rehashing widens, and exact distances for vectors that fall into enough windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage
from .vectors import matrix, usable

#: Vectors of a data block, and queries that meet it in a task: an index is built once for so many queries.
BLOCK, QUERIES = 8192, 16_384
#: The search ends when its radius is so many times the distance of the k-th vector found.
MARGIN = 1.02


class CollisionIndex:
    """Sorted projections of a block. At radius r a vector within r of the query falls into a window of width 2r around the query's
    projection with probability 0.68 each, one within r / margin more often; share of all windows makes it a candidate, which is verified."""

    def __init__(self, data: np.ndarray, projections: int, share: float, growth: float, seed: int, margin: float = MARGIN) -> None:
        self.data, self.growth, self.margin = data, growth, margin
        n, dim = data.shape
        self.axes = np.random.default_rng(seed).normal(size=(dim, projections))
        self.need = int(np.ceil(share * projections))
        at = data @ self.axes
        order = np.argsort(at, axis=0, kind="stable")
        at = np.take_along_axis(at, order, 0)
        self.low, self.high = at[0].copy(), at[-1].copy()
        # Each array has a stretch of its own, so that one search finds the windows of all.
        self.shift = np.concatenate([[0.0], np.cumsum(self.high - self.low + 1)])[:-1] - self.low
        self.sorted = (at + self.shift).T.ravel()
        self.ids = order.astype(np.uint16 if n <= 1 << 16 else np.int64).T.ravel()
        self.spread = np.arange(0, n, max(1, n // 256))

    def search(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the verified vectors when k of them lie well within the radius (by the margin), or all vectors are verified.

        Counts go on from radius to radius: only what a window gains at its two ends is counted."""
        n = len(self.data)
        spot = query @ self.axes
        known, times = skip.copy(), np.zeros(n, np.int64)
        others = self.spread[~skip[self.spread]]  # the least distance to some other vectors: a radius that can't be far too small
        near = float(np.sqrt(((self.data[others] - query) ** 2).sum(1)).min()) if len(others) else 1.0
        rows, dist, radius = np.zeros(0, np.int64), np.zeros(0), max(1e-9, 0.75 * near)
        lo = hi = np.searchsorted(self.sorted, np.clip(spot, self.low - 0.5, self.high + 0.5) + self.shift)
        while True:
            lo_2 = np.searchsorted(self.sorted, np.clip(spot - radius, self.low - 0.5, self.high + 0.5) + self.shift, "left")
            hi_2 = np.searchsorted(self.sorted, np.clip(spot + radius, self.low - 0.5, self.high + 0.5) + self.shift, "right")
            gained = [self.ids[a:b] for a, b in zip(lo_2.tolist(), lo.tolist()) if a < b] + [self.ids[a:b] for a, b in zip(hi.tolist(), hi_2.tolist()) if a < b]
            lo, hi = lo_2, hi_2
            if gained:
                times += np.bincount(np.concatenate(gained), minlength=n)
                new = np.flatnonzero((times >= self.need) & ~known)
                if len(new):
                    known[new] = True
                    rows = np.concatenate([rows, new])
                    dist = np.concatenate([dist, np.sqrt(((self.data[new] - query) ** 2).sum(1))])
            if known.all() or (dist * self.margin <= radius).sum() >= k:
                return rows, dist
            radius *= self.growth


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, projections: int = 256, share: float = 0.65, growth: float = 1.05, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for each query, by Euclidean distance, ties to the smaller vec_id.

    A stated query set meets all vectors in blocks: each task holds the index of a block of vectors and up to QUERIES queries,
    each block gives k vectors a query, and these are ranked. share trades verified vectors for recall. Vectors (and queries) that are null, empty, zero or hold null or
    non-finite components take no part; only vectors of the query's length are its candidates. A vector with the query's id is its
    own; repeated rows count once, and of several vectors under one id the nearest counts. A query id with several vectors
    searches with the least of them. No vectors or no queries give no rows.
    """
    base = vectors.select("vec_id", F.col("embedding").alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("v"))
    asked = queries.select("vec_id", F.col("embedding").alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    asked = stage(asked.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "queries")
    data_blocks, query_blocks = -(-base.count() // BLOCK), -(-asked.count() // QUERIES)
    if not data_blocks or not query_blocks:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)

    def block(n: int):
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def all_of(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = base.select("vec_id", "v", "dim", block(data_blocks).alias("d"), all_of(query_blocks).alias("q"))
    right = asked.select("vec_id", "v", "dim", block(query_blocks).alias("q"), all_of(data_blocks).alias("d"))
    kind = dict(base.dtypes)["vec_id"]

    def search(data: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if data.num_rows and wanted.num_rows:
            ids, x = data.column("vec_id").to_numpy(), matrix(data.column("v"))
            order = np.lexsort((*x.T[::-1], ids))
            ids, x = ids[order], x[order]
            once = np.concatenate([[True], (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(1)])
            ids, x = ids[once], x[once]
            index = CollisionIndex(x, projections, share, growth, seed)
            for q, v in zip(wanted.column("vec_id").to_numpy(), matrix(wanted.column("v"))):
                rows, dist = index.search(v, k, ids == q)
                order = np.lexsort((ids[rows], dist))
                found, first = np.unique(ids[rows[order]], return_index=True)
                best = order[np.sort(first)[:k]]
                for column, values in zip(out, (np.full(len(best), q), ids[rows[best]], dist[best])):
                    column.append(values)
        q, v, s = (np.concatenate(c) if c else [] for c in out)
        return pa.table({"query_id": pa.array(q, data.schema.field("vec_id").type), "vec_id": pa.array(v, data.schema.field("vec_id").type), "score": pa.array(s, pa.float64())})

    keys = ["d", "q", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
