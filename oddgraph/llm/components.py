"""Connected components by min-label propagation with pointer jumping, all in distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddgraph.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge: the label is the smallest node reachable.

    Each round takes the smallest label among the neighbours (partial sums before the shuffle, so a
    hub's edges are not gathered), then jumps to the label's label; lineage is cut by a table in the
    shared folder. An empty edge table gives an empty result.
    """
    e = edges.select(F.col(edges.columns[0]).alias("a"), F.col(edges.columns[1]).alias("b")).where("a <> b")
    e = stored(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(e.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = e.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = stored(step.join(jump, "label").select("node", F.least("label", "far").alias("label"), "was"), "labels")
        labels = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            return labels
