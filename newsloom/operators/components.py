"""Connected components of an undirected edge list, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.storage import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Labels each node of ``edges`` with the smallest node of its component.

    Alternates a minimum over neighbours with pointer jumping, so that chains
    shrink geometrically. Each round is two shuffles of the edge list, combined
    on the map side; nothing is collected but one counter. Null ends and loops
    are ignored, repeated edges do no harm. Returns ``node, component``.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = cut(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = cut(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("component")).withColumnRenamed("x", "node"))
    while True:
        near = (
            both.join(label, both["y"] == label["node"])
            .groupBy("x")
            .agg(F.min("component").alias("near"))
        )
        lower = label.join(near, label["node"] == near["x"]).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("low")
        )
        parent = label.select(F.col("node").alias("p"), F.col("component").alias("pp"))
        jumped = cut(
            lower.join(parent, lower["low"] == parent["p"], "left").select(
                "node", "old", F.least("low", F.coalesce("pp", "low")).alias("component")
            )
        )
        changed = jumped.where("component <> old").limit(1).count()
        label = jumped.select("node", "component")
        if not changed:
            return label
