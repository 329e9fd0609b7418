"""Connected components of records that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Scratch, cut


def connected_components(edges: DataFrame, node: str = "node", key: str = "key") -> DataFrame:
    """(node, component): component is the smallest node reachable over shared keys.

    ``edges`` is a (node, key) table.  Keys held by one node are dropped first.  Each
    round takes the smallest label per key and per node (map-side combined minima)
    and then jumps to the label's own label, so long chains close in few rounds.  No
    pairs inside a key are produced.
    """
    e = edges.select(F.col(node).alias("node"), F.col(key).alias("key")).distinct()
    shared = e.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi")
    e = cut(e.join(shared.select("key"), "key", "left_semi"))
    labels = e.groupBy("node").agg(F.min("node").alias("component"))
    while True:
        by_key = e.join(labels, "node").groupBy("key").agg(F.min("component").alias("component"))
        by_node = e.join(by_key, "key").groupBy("node").agg(F.min("component").alias("reached"))
        step = labels.join(by_node, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "reached").alias("component")
        )
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        nxt = cut(
            step.join(jump, "component", "left").select(
                "node", "old", F.least("component", F.coalesce("further", "component")).alias("component")
            )
        )
        labels = nxt.select("node", "component")
        if nxt.filter("old <> component").isEmpty():
            break
    everyone = edges.select(F.col(node).alias("node")).distinct()
    return everyone.join(labels, "node", "left").select(
        F.col("node").alias(node), F.coalesce("component", "node").alias("component")
    )


def contracted_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of the nodes that share a key with another: one root for all that are reachable over shared keys.

    ``edges`` is a (node, key) table of hashes.  Each turn moves every node to the smallest one that shares a key with
    it and goes on with the keys that then still tie different nodes together.  As hashes stand in a random order, even
    a chain shrinks by a constant factor with each turn.
    """
    left, met, moves = edges.distinct(), None, []
    while True:
        shared = left.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi")
        before, met = met, scratch.keep(left.join(shared.select("key", "lo"), "key").select("node", "key", "lo"))
        if before is not None:
            scratch.drop(before)
        if met.isEmpty():
            break
        moves.append(scratch.keep(met.groupBy("node").agg(F.min("lo").alias("root"))))
        left = met.join(moves[-1], "node").select(F.col("root").alias("node"), "key").distinct()
    roots = moves.pop() if moves else met.select("node", F.col("lo").alias("root"))
    while moves:
        further = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
        followed = moves[-1].join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        before, roots = roots, scratch.keep(followed)
        scratch.drop(before, moves.pop())
    return roots
