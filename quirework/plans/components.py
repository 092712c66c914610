"""Connected components by contraction: every node hooks to its smallest neighbour, hooks are followed by doubling, and the edges
between what is left go on to the next round.  Rounds and doublings go with the logarithm of the number of nodes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settle import settle


def follow(hooks: DataFrame) -> DataFrame:
    """(node, root) with every root followed to the end, of hooks without cycles; a node hooked to itself is an end."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("_far"))
        hooks = settle(hooks.join(up, "root").select("node", F.col("_far").alias("root"), (F.col("_far") != F.col("root")).alias("_moved")))
        if hooks.filter("_moved").isEmpty():
            return hooks.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v); root is the smallest node of its component."""
    live = edges.filter(F.col("u") != F.col("v")).select("u", "v")
    live = settle(live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    found = None
    while True:
        hooks = follow(live.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_m")).select(
            "node", F.least("node", "_m").alias("root")))
        if found is None:
            found = hooks
        else:
            later = hooks.select(F.col("node").alias("root"), F.col("root").alias("_r"))
            found = settle(found.join(later, "root", "left").select("node", F.coalesce("_r", "root").alias("root")))
        ends = live.join(hooks.select(F.col("node").alias("u"), F.col("root").alias("_u")), "u").join(
            hooks.select(F.col("node").alias("v"), F.col("root").alias("_v")), "v")
        live = settle(ends.filter(F.col("_u") != F.col("_v")).select(F.col("_u").alias("u"), F.col("_v").alias("v")).distinct())
        if live.isEmpty():
            return found
