"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import staged

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect each node's neighbours to the least of them: the larger ones, or else the node and the smaller ones.

    The neighbours' least is aggregated before it is joined back, so a node of very many edges is split by
    the adaptive skew join and never gathered.
    """
    if large:
        sides = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        return sides.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    ends = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return ends.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) of every node of the edges (a, b), longs.

    Edges with a null end and loops link nothing. Every round is a written table, so nothing is recomputed after a
    loss. The rounds needed grow with the logarithm of the number of nodes; MAX_ROUNDS fails loudly.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = staged(ordered, "edges")
    for _ in range(MAX_ROUNDS):
        after = staged(_star(staged(_star(now, True).distinct(), "large"), False).distinct(), "small")
        state = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        if after.agg(state).first()[0] == now.agg(state).first()[0]:
            found = after.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return found.unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        now = after
    raise RuntimeError("components did not settle")
