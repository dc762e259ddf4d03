"""Connected components of a graph given as a table of links.

Alternating stars: every round links each node to the smallest node it knows,
first for larger neighbours, then for smaller ones, until the links are stars
around the smallest node of each component.  Each half round is one grouped
minimum and one equi-join between tables in the shared folder, so Spark can
split the links of a hub over many tasks and no task holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link at most to a smaller node, and none that has one is the end of another."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not each.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """``links`` (a, b), any order, repeats allowed -> one row (node, label) per
    linked node; label is the smallest node of its component.  Nodes must be
    longs.  Self-links and nulls are ignored; no links give no rows."""
    u, v = F.greatest("a", "b"), F.least("a", "b")
    now = stages.put(links.where("a is not null and b is not null and a <> b").select(u.alias("u"), v.alias("v")).distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stages.put(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stages.put(large.distinct())
        stages.drop(least)
        least = stages.put(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stages.put(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        stages.drop(least, large, now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
