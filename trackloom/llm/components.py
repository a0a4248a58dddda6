"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import materialize


def _are_stars(links: DataFrame) -> bool:
    """Whether every node is the larger end of one link at most, and no smaller end is the larger one of another."""
    leaf = links.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre"))
    centre = links.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre"))
    ends = leaf.unionByName(centre).groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return ends.where("leaf + centre > 1").isEmpty()


def connected_components(links: DataFrame, label: str = "links") -> DataFrame:
    """``node, component`` (the smallest node) of every node in ``links(u, v)``.

    Nodes may be of any type that has an order; links with a null end or of a node to itself count for nothing. Each
    step joins links to the smallest neighbour of each node, a partial aggregate, so a node with very many
    links is never gathered; the smallest neighbours are a table of their own, so that the adaptive planner
    can split the join. The number of rounds grows with the logarithm of the longest path; links that are
    stars from the start, as those of most blocks are, need none. Each round is written to the shared folder.
    """
    now = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, label)
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), label + "-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, label + "-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), label + "-low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
