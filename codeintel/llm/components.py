"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b) with its least connected node.

    Large-star and small-star steps halve the depth of the trees in each round.
    The least neighbour of every node is an aggregate with map-side combining, and
    is joined back to the edges: a hub is one row on that side, and its edges on
    the other can be split over tasks (adaptive execution does).  Rounds are
    written to the shared folder.  Nothing but counts reaches the driver.
    """
    cur = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = _mark(cur)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")
        # now every edge points down: u > v
        down = large.distinct()
        small = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
        nxt = materialize(small.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        now = _mark(nxt)
        discard(cur)
        cur = nxt
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not converge")
    low = cur.groupBy("b").agg(F.lit(1)).select(F.col("b").alias("node"), F.col("b").alias("component"))
    out = cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(low)
    out._scratch = cur._scratch
    return out


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest: equal when a round changed nothing."""
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).collect()[0]
    return r["n"], r["x"]
