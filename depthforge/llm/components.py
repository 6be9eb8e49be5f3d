"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b); a component is named by its least node.

    Alternating large-star and small-star rounds: each node sends its larger, then its smaller
    neighbours to its least neighbour, until no edge changes. Edges never grow in number, and the
    rounds are logarithmic in the nodes. Only counts and sums reach the driver. Nulls have no edges.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    state = materialize(pairs, "edges")
    mark = _mark(state)
    while mark[0]:
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the least neighbours are written, so that a join with them may split the many neighbours of one node
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = materialize(both.filter("v > u").join(least.hint("merge"), "u").filter("v <> m").select("v", F.col("m").alias("u")).distinct(), "large")
        # small star: u is the larger end, its neighbours v the smaller ones
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = down.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u")
        state = materialize(small.filter("v <> u").distinct(), "edges")
        now = _mark(state)
        if now == mark:
            break
        mark = now
    stars = state.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.unionByName(state.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _mark(state: DataFrame) -> tuple:
    n, total = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return n, total
