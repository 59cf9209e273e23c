"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import kept_small


def signature(edges: DataFrame) -> tuple:
    """Changes when the set of edges does."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Point each node's larger (``large``) or smaller neighbours at the least of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links(a, b)``; the component is its smallest node.

    Alternating large and small stars: each step is a map-side minimum and a join, no step
    holds a component in one task, and the number of steps grows with its logarithm.
    Links from a node to itself and repeated links change nothing.
    """
    edges = kept_small(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(),
        "links",
    )
    before = signature(edges)
    while True:
        edges = kept_small(star(star(edges, large=True), large=False), "stars")
        after = signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
