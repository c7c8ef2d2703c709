"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected edges of any orderable type to (node, root): each node's smallest reachable node.

    Alternates large-star and small-star steps (Kiveris et al., Connected Components in
    MapReduce and Beyond, 2014).  Every round moves each edge closer to a star around the
    smallest node; the number of rounds grows with the logarithm of the longest path.  Nodes
    that are roots themselves are in the result; an empty table gives no rows; loops and nulls
    are left out.  Each round is cut, so a lost executor costs one round.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", least).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = F.min("v").over(Window.partitionBy("u"))
        small = large.withColumn("m", least)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        links = cut(small)
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        # done when every edge goes from a node with no other edge to a root
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up > 0 and root > 0").isEmpty():
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
