"""Connected components by contraction, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b): node and component, the smallest node reachable, for each node that has an edge.

    Each round joins every node to the smallest of its neighbours and itself, follows these links twice, gives
    the edges the new names and drops those inside. Tables are written between rounds; nothing is collected."""
    both = edges.filter("a <> b").select("a", "b")
    live = stored(both.distinct(), "edges")
    labels = None
    while not live.isEmpty():
        sides = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(sides.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents")
        for _ in range(2):
            over = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
            up = up.join(over, "p").select("a", F.col("q").alias("p"))
        up = stored(up, "roots")
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            step = up.select(F.col("a").alias("component"), "p")
            labels = stored(labels.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        a, b = up.select("a", F.col("p").alias("x")), up.select(F.col("a").alias("b"), F.col("p").alias("y"))
        after = stored(live.join(a, "a").join(b, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        forget(live)
        live = after
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
