"""Connected components of an undirected edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, stage


def connected_components(edges: DataFrame, a: str = "node1", b: str = "node2") -> DataFrame:
    """node and component (the smallest node of it), for every node of an edge; ids of any ordered type.

    Rounds of neighbour minimum and pointer jumping until no label changes, each staged in the shared folder.
    Labels are narrow, the joins are plain equi-joins that Spark can split at a hub, and the minimum is
    combined before the shuffle. Edges with a null end are ignored; self loops only name their node.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    both = stage(one.union(one.select("v", "u")).distinct(), "cc-edges")
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("component")), "cc-labels")
    held = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("least"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "least").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = stage(lower.join(jump, "component").select("node", "before", F.least("component", "root").alias("component")), "cc-labels")
        discard(held)
        held, labels = moved, moved.select("node", "component")
        if moved.filter("component <> before").isEmpty():
            discard(both)
            return labels
