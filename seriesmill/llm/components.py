"""Connected components of a large edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesmill.llm.common import stored
from seriesmill.session import bounded_broadcast


def _smallest(pairs: DataFrame) -> DataFrame:
    """Adds m, the smallest of u and its neighbours, to pairs (u, v).

    The minimum is a partial aggregate.  It is written before the join: were both to share one
    exchange, the pairs of a hub would all meet in one task.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(bounded_broadcast(stored(least, "least")), "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v): root is the smallest node of its component.

    Every round writes the edges anew; the number of rounds grows with the logarithm of the longest
    path.  Edges with a null end and loops join nothing; repeated edges count once.
    """
    edges = edges.select("u", "v").where("u <> v")
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _smallest(large)
        edges = stored(
            down.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))
