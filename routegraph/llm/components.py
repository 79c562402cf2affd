"""Connected components by alternating large-star and small-star rounds over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land, salted_join


def _star(pairs: DataFrame, only_larger: bool) -> DataFrame:
    """Link each node's neighbours to the smallest id around it. ``pairs``, made of a landed table, holds (u, v) for each
    neighbour v of u. An aggregate and a salted join, not a grouped list, so a hub with any number of
    neighbours comes to no one task."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = salted_join(pairs, least, "u", "v")
    if only_larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, first: str, second: str) -> DataFrame:
    """(node, component) for every node of ``links``; the component is the smallest id reachable.

    Self-links, repeated links and links with a null end are ignored; no links give no rows.
    """
    ends = links.where(F.col(first) != F.col(second))
    edges = land(ends.select(F.greatest(first, second).cast("long").alias("u"), F.least(first, second).cast("long").alias("v")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = land(_star(both, True).where("u <> v").distinct(), "large-star")
        small = _star(large, False).where("u > v").distinct()
        edges = land(small, "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
