"""Connected components of links that arrive in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import stage
from fieldglass.operators.graph import components


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b), without nulls."""
    return components(edges, "a", "b")


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (node, component) after more links (a, b): the components that the links join are the only ones that change."""
    ends = links.select("a", "b").join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    ends = ends.join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    between = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("new"))
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct().join(labels, "node", "left_anti")
    everyone = labels.unionByName(nodes.withColumn("component", F.col("node")))
    return stage(everyone.join(merged, "component", "left").select("node", F.coalesce("new", "component").alias("component")), "labels")
