"""Connected components of a distributed edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_scratch, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for every node of the edges (a, b), long, the least node that it reaches.

    Every round halves paths with two star steps, each a sum by node and an
    equi-join, so a hub with any number of edges is counted before it is shuffled
    and split by adaptive execution where it is joined.  Self-links and repeated
    edges are allowed; links stay in the cluster.
    """
    proper = lambda e: e.filter("a <> b").distinct()
    now = materialize(proper(edges), "edges")
    before = _state(now)
    while before[0]:
        new = materialize(proper(_small_star(proper(_large_star(now)))), "edges")
        after = _state(new)
        drop_scratch(now)
        now, same, before = new, after == before, after
        if same:
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return leaves.unionByName(leaves.select(F.col("label").alias("node"), "label").distinct())
