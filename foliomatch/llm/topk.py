"""Exact top-k by inner product: rounds of sorted-list reading without random access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomatch.plans.stages import shuffle_partitions

#: Vectors of a shard and queries of a block at most: what one task holds. Shards are smaller, but not below
#: ``LEAST_ROWS``, where cores would be idle.
SHARD_ROWS, QUERY_ROWS, LEAST_ROWS = 32_768, 16_384, 8192
#: Share of every list that is read first, by what a further round multiplies how far it is read, and share of the rows
#: that are resolved at most before the lists are read to their ends.
FIRST_SHARE, FURTHER, RESOLVE = 1 / 4, 1.2, 1 / 8


def clean_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``(vec_id, x array<double>)`` without vectors that are null, empty or hold null or non-finite components."""
    x = F.col(column).cast("array<double>")
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def quantized(x: Column, scale: int = 256) -> Column:
    """Every component as floor(scale * x); what leaves 64 bits stops at their ends."""
    return F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))


class Lists:
    """The rows of a shard as one list of (row, value) by value for each dimension."""

    def __init__(self, v: np.ndarray, ids: np.ndarray):
        self.v, self.ids = v, ids
        self.rows = np.argsort(v, axis=0, kind="stable").T.astype(np.int32)  # by dimension, ascending
        # where each row is in each list, in 16 bits where they hold it
        self.place = np.empty(self.rows.shape, np.uint16 if len(v) < 1 << 16 else np.int32)
        np.put_along_axis(self.place, self.rows, np.arange(len(v), dtype=self.place.dtype)[None], 1)
        values = np.sort(v, axis=0).T
        kind = np.float32 if int(np.abs(v).max(initial=0)) < 1 << 11 else np.float64  # products stay whole numbers
        self.over, self.under = (values - values[:, :1]).astype(kind), (values - values[:, -1:]).astype(kind)  # from either end

    def best(self, q: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, float]:
        """Rows that can be among the ``k`` best for ``q``, none outside them can qualify; and the share of the lists read.

        A list is read from its top where the query's component is positive, from its end where it is negative. What has
        been read of a row, with the list's far end for the rest, is its lower bound; with the last values read of those
        lists in which the row has not been met yet it is its upper bound, as these have no more to give. Reading stops
        when few rows are left whose upper bound reaches the k-th lower bound; of rows that no list has shown yet, too.
        """
        n = len(self.v)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        kind = self.over.dtype if int(np.abs(q).max(initial=0)) < 1 << 11 else np.float64
        w = np.abs(np.concatenate([q[up], q[down]])).astype(kind)[:, None]
        behind = np.concatenate([self.place.dtype.type(n - 1) - self.place[up], self.place[down]])  # rows of the list that are read before
        sums, own, depth = np.zeros(n), np.flatnonzero(self.ids == own_id), 0
        while True:
            to = min(n, max(int(FIRST_SHARE * n), int(FURTHER * depth)) + 1)
            tops, bottoms = slice(n - to, n - depth), slice(depth, to)
            rows = np.concatenate([self.rows[up, tops], self.rows[down, bottoms]])
            gains = np.concatenate([self.over[up, tops], -self.under[down, bottoms]]) * w  # over the list's far end
            sums += np.bincount(rows.ravel(), gains.ravel(), n)
            sums[own], depth = -np.inf, to
            cut = np.partition(sums, n - k)[n - k] if n >= k else -np.inf
            if depth == n:
                return np.flatnonzero(sums >= cut), 1.0
            last = (np.concatenate([self.over[up, n - depth], -self.under[down, depth - 1]]) * w[:, 0]).astype(np.float64)
            can = np.flatnonzero(sums + last @ (behind >= behind.dtype.type(depth)).astype(np.float64) >= cut)
            if len(can) <= RESOLVE * n:
                return can, depth / n


def search(v: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """``(query, id, score)`` of the k best rows of ``v`` for each query, by bounded sequential reading.

    Bounds are exact while sums stay below 2^53. Beyond that every row is resolved in integers of any size, and scores
    stop at the ends of 64 bits, which then tie.
    """
    far = int(np.abs(v.astype(np.float64)).max(initial=0)) * int(np.abs(q.astype(np.float64)).max(initial=0)) * v.shape[1]
    exact = v.astype(object) if far >= 1 << 62 else v
    lists = Lists(v, ids) if far < 1 << 53 and len(v) else None
    out = []
    for one, own_id in zip(q, qids.tolist()):
        left = np.flatnonzero(ids != own_id) if lists is None else lists.best(one, own_id, k)[0]
        left = left[ids[left] != own_id]
        score = exact[left] @ one.astype(exact.dtype)
        if exact.dtype == object:
            score = np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in score], object)
        for i in np.lexsort((ids[left], -score))[:k]:
            out.append((own_id, int(ids[left[i]]), int(score[i])))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank int, vec_id, score long)``: for each query the k best of all other vectors, exactly.

    Both inputs are ``(vec_id, x array<long>)``. The score is the integer inner product, ties go to the smaller vec_id,
    ranks start at 1. Vectors of another length than the query's are not compared with it; rows that share the query's
    vec_id are the query itself; a vec_id that is repeated competes with each of its rows, and a query that is repeated
    is asked once, by its first vector. Rows without a vec_id take no part. Scores stop at the ends of 64 bits and then
    tie. Fewer than k others give fewer rows, empty inputs none.

    Vectors are dealt into shards and queries into blocks; every pair of a shard and a block is one task of bounded
    size, whose lists are sorted and read there. A shard is sent out once for each block, so blocks are large. The k
    best of a task per query go on to one small window.
    """
    n = vectors.count()
    idle = min(shuffle_partitions(vectors.sparkSession), -(-n // LEAST_ROWS))
    shards = max(1, -(-n // SHARD_ROWS), idle)
    queries = queries.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("x").alias("x"))
    vectors = vectors.where("vec_id IS NOT NULL")
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    rest = F.size("x").alias("dim")

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id", "x"), F.lit(n)).cast("int").alias(own)
        return df.select(rest, mine, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), "vec_id", "x")

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x = t.column("x").combine_chunks()
        return x.flatten().to_numpy().reshape(t.num_rows, -1), t.column("vec_id").to_numpy()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = search(*matrix(left), *matrix(right), k) if left.num_rows and right.num_rows else []
        return pa.table({n: pa.array([r[i] for r in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    keys = ["dim", "shard", "block"]
    grid = dealt(vectors, "shard", shards, "block", blocks).groupBy(keys).cogroup(dealt(queries, "block", blocks, "shard", shards).groupBy(keys))
    found = grid.applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
