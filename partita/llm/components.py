"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; each keeps the components and shortens the paths.

    The smallest neighbour of a node is a map-side minimum joined back to its edges, so the centre of
    a huge star is never gathered into one task (the join may be split as a skewed one).
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(down.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(u, v) links of long ids -> (node, root): root is the smallest id of node's component.

    Only nodes with a link to another node are returned.  Self links, repeated and mirrored links are
    accepted; links with a null end are no links.  Each round is written to the shared folder; the loop
    ends when a round changes nothing, after a number of rounds logarithmic in the longest path.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = scratch.write(edges.distinct(), f"{name}-0")
    mark, k = _mark(now), 0
    while mark[0]:
        k += 1
        now = scratch.write(_stars(now), f"{name}-{k}")
        after = _mark(now)
        scratch.drop(f"{name}-{k - 1}")
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = scratch.write(roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), f"{name}-roots")
    scratch.drop(f"{name}-{k}")
    return roots


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free digest of the links."""
    r = edges.agg(
        F.count(F.lit(1)),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        F.bit_xor(F.xxhash64("v", "u")),
    ).first()
    return tuple(r)
