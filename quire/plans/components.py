"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.scratch import Scratch


def _through(df: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """Replace ``column`` by its hook where it has one."""
    h = hooks.select(F.col("r").alias("_r"), F.col("h").alias("_h"))
    return df.join(h, df[column] == h["_r"], "left").withColumn(column, F.coalesce("_h", column)).drop("_r", "_h")


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Each round hooks every node that is the larger end of an edge onto the smallest such neighbour,
    flattens the hooks to their roots by pointer jumping, and contracts the edges. Nodes without a
    smaller neighbour are all that stays, so the graph at least halves; nothing is sent to the driver
    but counts. Edges with a null end and loops are ignored; a node that only has loops is not returned.
    """
    scratch = scratch or Scratch(spark, "components")
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    edges = scratch.keep(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    labels = scratch.keep(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")))
    while not edges.isEmpty():
        hooks = scratch.keep(edges.groupBy(F.col("b").alias("r")).agg(F.min("a").alias("h")))
        while True:
            up = hooks.select(F.col("r").alias("_r"), F.col("h").alias("_h"))
            jumped = scratch.keep(hooks.join(up, hooks["h"] == up["_r"], "left").select("r", F.coalesce("_h", "h").alias("h"), F.col("_h").isNotNull().alias("moved")))
            more = not jumped.where("moved").isEmpty()
            scratch.drop(hooks)
            hooks = jumped
            if not more:
                break
        next_labels = scratch.keep(_through(labels, "component", hooks))
        moved = _through(_through(edges, "a", hooks), "b", hooks).where("a != b")
        next_edges = scratch.keep(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        scratch.drop(hooks, labels, edges)
        labels, edges = next_labels, next_edges
    return labels
