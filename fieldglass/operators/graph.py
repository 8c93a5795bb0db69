"""Least-cost routes by frontier rounds, components, and ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.staging import stage, unstage


def edge_cost(seconds: Column, flag: Column, multiplier: float = 1.0) -> Column:
    """Time divided by priority; the priority of flagged edges is multiplied, by 1 at most."""
    if not 0 < multiplier <= 1:
        raise ValueError("a multiplier lies above 0 and is at most 1")
    return seconds / F.when(flag, F.lit(float(multiplier))).otherwise(F.lit(1.0))


def least_costs(edges: DataFrame, sources: DataFrame, max_cost: float) -> DataFrame:
    """source, node, cost of the cheapest path from each source (column `node`) up to max_cost, over edges (src, dst, cost).

    Each round relaxes only from nodes that got cheaper in the last one, so the work follows the
    frontier; it ends when none did. Costs are not negative.
    """
    edges = stage(edges, "edges")
    if not edges.where("cost < 0").isEmpty():
        raise ValueError("an edge has a negative cost")
    # All improvements of all rounds, one table a round; the least of a node's is its cost.
    rounds = [stage(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost")), "reached")]
    while True:
        step = rounds[-1].join(edges.withColumnRenamed("cost", "c"), F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("cost") + F.col("c")).alias("cost"))
        step = step.where(F.col("cost") <= max_cost).groupBy("source", "node").agg(F.min("cost").alias("cost"))
        known = rounds[0]
        for r in rounds[1:]:
            known = known.unionByName(r)
        known = known.withColumnRenamed("cost", "known")
        better = stage(step.join(known, ["source", "node"], "left").groupBy("source", "node", "cost").agg(F.min("known").alias("known")).where("known is null or cost < known").drop("known"), "reached")
        if better.isEmpty():
            return known.groupBy("source", "node").agg(F.min("known").alias("cost"))
        rounds.append(better)
        if len(rounds) == 8:  # fold the tables into one but for the frontier
            folded = stage(known.groupBy("source", "node").agg(F.min("known").alias("cost")), "reached")
            unstage(*rounds[:-1])
            rounds = [folded, better]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b), without nulls.

    Each round takes the smallest label among a node's neighbours and then that label's own
    label, so paths shorten geometrically; only whether a label changed comes to the driver.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = stage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("c")).select(F.col("a").alias("node"), F.col("a").alias("old"), F.least("a", "c").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c")).withColumnRenamed("a", "node")
        better = labels.drop("old").join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = stage(better.join(hop, "component", "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component")), "labels")
        unstage(labels)
        labels = moved
        if moved.where("old <> component").isEmpty():
            unstage(both)
            return labels.select("node", "component")


def first_match(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """Ordered rules: the value of the first that holds; they do not accumulate. A condition that is null does not hold."""
    out = None
    for condition, value in rules:
        held = F.coalesce(condition, F.lit(False))
        out = F.when(held, value) if out is None else out.when(held, value)
    return otherwise if out is None else out.otherwise(otherwise)
