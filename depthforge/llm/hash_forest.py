"""Approximate nearest neighbours by a forest of hash prefixes.

Vectors are dealt into segments of bounded size. In each segment, every tree hashes a vector to a
long string of bits (signs of random projections) and keeps the strings in a sorted array. A query
descends each tree to its longest matching prefix, then all trees ascend together, one bit at a
time, until the stretches of the arrays under the prefixes hold enough candidates; these are
scored exactly. The nearest of all segments are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES = 64
BITS = 32
#: Entries under the prefixes of all trees, as a share of a segment's vectors, at which the ascent ends.
SHARE = 0.9
SEGMENT_ROWS = 16_384
QUERY_ROWS = 16_384


class HashForest:
    """Sorted arrays of hash strings over the rows of ``vectors``."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * bits)).astype(np.float32)
        keys = self.keys(vectors)
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, axis=0)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Hash string of each vector (row) in each tree (column), first bit highest."""
        out = np.zeros((len(vectors), self.trees), dtype=np.uint64)
        size = np.maximum(np.abs(vectors).max(axis=1, keepdims=True), np.finfo(np.float64).tiny)
        small = (vectors / size).astype(np.float32)  # a positive factor changes no sign
        for t in range(self.trees):
            above = small @ self.planes[:, t * self.bits : (t + 1) * self.bits] > 0
            out[:, t] = above @ (np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64))
        return out

    def stretches(self, queries: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) in each tree's array of what each query takes."""
        keys = self.keys(queries)
        low, high = np.zeros(keys.shape, dtype=np.int64), np.zeros(keys.shape, dtype=np.int64)
        climbing = np.arange(len(queries))
        for depth in range(self.bits, -1, -1):  # all trees at the same depth
            rest = np.uint64((1 << (self.bits - depth)) - 1)
            for t in range(self.trees):
                k = keys[climbing, t]
                low[climbing, t] = np.searchsorted(self.sorted[:, t], k & ~rest, side="left")
                high[climbing, t] = np.searchsorted(self.sorted[:, t], k | rest, side="right")
            climbing = climbing[(high[climbing] - low[climbing]).sum(axis=1) < enough]
            if not len(climbing):
                break
        return low, high

    def candidates(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows in the stretches of one query, each once."""
        found = np.zeros(len(self.vectors), dtype=bool)
        for t in np.flatnonzero(high > low):
            found[self.order[low[t] : high[t], t]] = True
        return np.flatnonzero(found)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` with vector ``b`` in double precision, the same for equal rows.

    Both are first divided by their largest component, so that no square overflows or vanishes.
    """
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max()
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum()))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, and not all of them 0."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, bits: int = BITS, share: float = SHARE, seed: int = 11, segment_rows: int = SEGMENT_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` nearest of ``vectors`` (vec_id, embedding) for each of ``queries`` (vec_id, embedding), by cosine.

    Returns query_id, rank (from 1), vec_id, score, nearest first and ties to the smaller vec_id.
    A query's own vec_id is no candidate of it, however often it occurs. Vectors that are null, zero
    or hold null or non-finite components take no part, nor do rows with a null vec_id; vectors are compared with those of
    their own length only. Of queries with the same vec_id the least vector counts. Repeated rows of
    ``vectors`` (same vec_id) count once, with the best score. Fewer than ``k`` candidates give all of them.
    Other columns are ignored; empty tables give no rows.
    """
    spark = vectors.sparkSession
    as_double = F.col("embedding").cast("array<double>").alias("embedding")
    take = lambda df: df.filter("vec_id is not null").select("vec_id", as_double).filter(usable(F.col("embedding")))
    points = take(vectors)
    asked = take(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    segments = max(1, -(-points.count() // segment_rows))
    blocks = max(1, -(-asked.count() // query_rows))
    # every block of queries meets every segment; rows are copied for that, never paired
    block_of = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    segment_of = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(segments))
    row = lambda df, segment, block, is_query: df.select(F.size("embedding").alias("dims"), segment.alias("segment"), block.alias("block"), F.lit(is_query).alias("is_query"), F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    left = row(points.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))), segment_of, F.col("block"), False)
    right = row(asked.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(segments - 1).cast("bigint")))), F.col("segment"), block_of, True)

    def search(table: pa.Table) -> pa.Table:
        is_query = np.asarray(table.column("is_query"))
        ids = table.column("vec_id").to_numpy()
        every = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        x, x_ids, q, q_ids = every[~is_query], ids[~is_query], every[is_query], ids[is_query]
        rows = []
        if len(x) and len(q):
            order = np.lexsort((*x.T[::-1], x_ids))  # the same forest whatever the order of arrival
            x, x_ids = x[order], x_ids[order]
            forest = HashForest(x, trees, bits, seed)
            low, high = forest.stretches(q, max(4 * k, int(share * len(x))))
            for i in range(len(q)):
                at = forest.candidates(low[i], high[i])
                at = at[x_ids[at] != q_ids[i]]
                if len(at):
                    score = cosine(x[at], q[i])
                    best = np.lexsort((x_ids[at], -score))
                    _, first = np.unique(x_ids[at][best], return_index=True)
                    best = best[np.sort(first)[:k]]
                    rows.append((np.full(len(best), q_ids[i]), x_ids[at][best], score[best]))
        if not rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b, c = (np.concatenate(part) for part in zip(*rows, strict=True))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    found = left.unionByName(right).groupBy("dims", "segment", "block").applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
