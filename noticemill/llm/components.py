"""Connected components of links whose hub may hold very many of them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import mix

PART_LINKS = 200_000  # links that one task joins
PART_ROWS = 500_000  # rows of a narrow table that one task reads


def settled(df: DataFrame) -> DataFrame:
    """``df`` cut and read in no more partitions than its rows or the cluster's cores ask for.

    Narrow tables that several joins read then cost few shuffle files, however many partitions made them.
    """
    done = cut(df)
    cores = 4 * df.sparkSession.sparkContext.defaultParallelism
    return done.coalesce(max(cores, math.ceil(done.count() / PART_ROWS)))


class Groups:
    """Disjoint sets of labels."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def priority(node: np.ndarray, turn: int) -> np.ndarray:
    """A draw for each node that differs from turn to turn."""
    return mix(node.astype(np.int64).view(np.uint64) + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15))


def forest(a: np.ndarray, b: np.ndarray, turn: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of some links; a root is its component's smallest draw (no turn: smallest node)."""
    groups = Groups()
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        groups.join(x, y)
    node = np.unique(np.concatenate([a, b]))
    group = np.fromiter((groups.root(x) for x in node.tolist()), np.int64, len(node))
    order = np.lexsort((node, node if turn is None else priority(node, turn), group))
    first = np.ones(len(order), bool)
    first[1:] = np.diff(group[order]) != 0
    root = np.empty(len(node), np.int64)
    root[order] = node[order][first][np.cumsum(first) - 1]
    return node, root


def components(links: DataFrame, part_links: int = PART_LINKS) -> DataFrame:
    """(node, label) of a (a, b) link table: the smallest node reachable, for every node that has a link.

    Links are dealt evenly into parts of at most about ``part_links``, a hub's links too, and each task reduces its part to
    one row a node: the root of the node's tree.  Nodes that stand in several parts tie their roots together, and a node
    moves to the foremost of its roots and from there to that one's; what is left are links between fewer nodes, for the
    next turn.  The order of nodes is drawn anew each turn, so chains shrink by a constant factor as well.  When one part
    holds all links, the turn is the last.  Then every node follows its moves, and the smallest of each end is its label.
    """
    edges = cut(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct())
    moves: list[DataFrame] = []
    while n := edges.count():
        parts = math.ceil(n / part_links)
        turn = len(moves) if parts > 1 else None

        def join(batches: Iterator[pa.RecordBatch], turn: int | None = turn) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
            node, root = forest(*(table.column(c).to_numpy() for c in ("a", "b")), turn)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

        dealt = edges.coalesce(1) if parts == 1 else edges.repartition(parts, "a", "b")  # one part: surely one task
        rooted = cut(dealt.mapInArrow(join, "node long, root long"))
        if parts == 1:
            moves.append(rooted.withColumnRenamed("root", "label"))
            break

        def draw(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                drawn = priority(batch.column(1).to_numpy(), turn).view(np.int64) ^ np.int64(-(2**63))  # unsigned order
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn)], names=["node", "root", "draw"])

        drawn = rooted.mapInArrow(draw, "node long, root long, draw long")
        top = drawn.groupBy("node").agg(F.min(F.struct("draw", "root"))["root"].alias("top"))
        top = cut(top)
        further = top.select(F.col("node").alias("top"), F.col("top").alias("label"))
        moved = cut(top.join(further.hint("merge"), "top").select("node", "label"))
        moves.append(moved)
        ends = moved.select(F.col("node").alias("root"), F.col("label").alias("b"))
        edges = cut(
            rooted.join(moved.hint("merge"), "node")
            .select("root", F.col("label").alias("a"))
            .join(ends.hint("merge"), "root")
            .filter("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))  # no links, no rows
    labels = moves[-1]
    for moved in reversed(moves[:-1]):
        last = labels.select(F.col("node").alias("label"), F.col("label").alias("final"))
        labels = moved.join(last.hint("merge"), "label", "left").select("node", F.coalesce("final", "label").alias("label"))
    if len(moves) == 1:
        return labels
    labels = cut(labels)
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return cut(labels.join(least.hint("merge"), "label").select("node", F.col("least").alias("label")))
