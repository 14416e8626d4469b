"""Connected components of an edge table, by alternating large and small stars.

A round replaces neighbours by the smallest known node: the large star hangs the larger neighbours of a node on the
smallest node around it, the small star the smaller ones. Every step is a minimum per node and a join, so a hub with
any number of neighbours is reduced before rows move, and its join may be split. Rounds end when the edges stay the
same; their number follows the logarithm of the number of nodes. Each round is a written table, so the plan stays short
and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.plans.session import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for all nodes of ``edges`` that are not the smallest of their component."""
    down = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    now = edges.where(F.col(a) != F.col(b)).select(*down(F.col(a), F.col(b))).distinct()
    now = stored(now, "components")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if before == state or not state["n"]:
            break
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(*down(F.col("v"), F.col("m"))).where("u != v").distinct()
        large = stored(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(*down(F.col("v"), F.col("m"))).union(least.select("u", "m"))
        now = stored(small.where("u != v").distinct(), "components")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
