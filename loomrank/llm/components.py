"""Connected components of an edge table, by label minimisation with pointer jumping.

Each round a node takes the smallest label among its neighbours and itself, and then the label of that label; labels
only fall, so the fixed point is the smallest node of each component. Rounds grow with the logarithm of a component's
diameter in practice. Every round is written to the shared folder, so lineage stays short and lost executors cost one
round. Minima are combined before the shuffle, so a node with very many neighbours isn't gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) of every node of edges (u, v); self-loops and repeated edges are allowed, null ends are not read."""
    clean = edges.filter("u is not null and v is not null")
    both = stage(
        clean.select("u", "v").unionByName(clean.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges"
    )
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("component")), "cc-labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels.select(F.col("node").alias("v"), "component"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        low = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("jumped"))
        new = stage(
            low.join(jump, "low").select("node", "old", F.least("low", "jumped").alias("component")), "cc-labels"
        )
        done = new.filter("old <> component").isEmpty()
        drop(labels)
        labels = new.select("node", "component")
        if done:
            drop(both)
            return labels
    raise RuntimeError("components did not settle")
