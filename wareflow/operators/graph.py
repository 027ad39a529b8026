"""Connected components of an edge table, by alternating star contractions with a written table between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import anew, discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation. Large: neighbours greater than a node are linked to the least of all; small: those smaller.

    The minimum is a map-side combined aggregate, so the neighbourhood of a node is never gathered; the join back to it is an
    ordinary equi-join, in which Spark splits hot keys.
    """
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(anew("a").alias("k"), "m")
    tied = both.join(least, F.col("a") == F.col("k"))
    if large:
        moved = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b): root is the least node that can be reached.

    Stops when a round leaves the edges as they were: then every edge goes to its component's least node.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    known = None
    for _ in range(rounds):
        before, now = now, materialize(_stars(_stars(now, True), False), "edges")
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if known == tuple(seen):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        known = tuple(seen)
    raise RuntimeError("components did not settle")
