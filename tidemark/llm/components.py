"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is one aggregation (partial sums first, so a hot node is no problem) and one
equi-join that adaptive execution can split. Every round is checkpointed, so an executor's
loss repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut


def _is_done(e: DataFrame) -> bool:
    """Whether every child has one parent and no parent is a child."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with a link; component: the smallest node reachable.

    Nulls and loops are dropped, repeated links count once, no links give no rows.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = cut(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct())
    while not _is_done(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        near = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        e = cut(near.distinct())
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        near = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(near.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
