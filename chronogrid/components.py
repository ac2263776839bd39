"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reached) of the nodes of edges ``u, v`` (longs).

    Large and small stars in turn (Kiveris et al., 2014): every step moves edges towards the
    smallest neighbour, until all edges are stars. A hub is an ordinary group: its minimum is
    combined before the shuffle, and the join with it is one that Spark splits when skewed.
    """
    edges = cut_lineage(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.distinct())
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
