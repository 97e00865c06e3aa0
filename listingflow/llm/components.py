"""Connected components by large-star and small-star rounds over an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one.  Minima are combined before the shuffle; the join
    back is an equi-join that adaptive execution can split where a node is frequent."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = both.join(least, "u").where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        hung = hung.union(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(u, v): every node that is not the smallest of its component, and that smallest node.

    ``edges`` has two long columns u and v.  Each round is written to the shared folder.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
    before = mark(edges)
    while before[0]:
        edges = stored(_stars(_stars(edges, True), False), name)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges
