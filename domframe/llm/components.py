"""Connected components by alternating large-star and small-star rounds on an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges(a, b), a > b: links each node's neighbours (the larger or the smaller ones) to its least."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        out = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (least node reachable) of each node of edges(a, b), both bigint; loops and repeats are allowed.

    Neighbours of a node are never collected: each round is two partial aggregations and joins that adaptive
    execution can split. Rounds grow with the logarithm of the longest path; the table of each goes to the shared folder.
    """
    now = common.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    sign = None
    for _ in range(rounds):
        after = common.written(_star(_star(now, True), False), "edges")
        common.discard(now)
        now = after
        new = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)).first())
        if new == sign:
            break
        sign = new
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
