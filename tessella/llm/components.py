"""Connected components by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import released
from .common import stash


def _mark(edges: DataFrame) -> tuple:
    """A number that changes with the set of edges."""
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node that has a link and isn't a root.

    links has two columns of node numbers.  Only minima and joins by node are used; each round is
    written to the shared folder, so no plan grows and none of it is collected.
    """
    a, b = (F.col(c) for c in links.columns)
    edges = stash(links.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        done, edges = edges, stash(small.unionByName(root.select("hi", F.col("m").alias("lo"))).distinct())
        now = _mark(edges)
        released(done)  # the new edges are written, so nothing reads these again
        if now == before:
            break
        before = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
