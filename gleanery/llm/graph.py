"""Connected components of an undirected graph held in tables, for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that one task settles (some 25 MB of its memory).
AT_ONCE = 1 << 18


def least_linked(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes on edges hi > lo, sorted, and the smallest node that each is linked with, itself included."""
    nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b, up = at[: len(hi)], at[len(hi) :], np.arange(len(nodes))
    while len(a):
        # As below: a root hooks to a smaller one, trees are flattened, edges inside a component go.
        np.minimum.at(up, a, b)
        while not np.array_equal(over := up[up], up):
            up = over
        a, b = up[a], up[b]
        a, b = np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]
    return nodes, nodes[up]


def settled(pairs: DataFrame) -> DataFrame:
    """node, component of every node on the edges hi > lo, in one executor task."""
    common.ship(pairs.sparkSession)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in least_linked(*map(np.concatenate, zip(*held)))], names=["node", "component"])

    return pairs.select("hi", "lo").coalesce(1).mapInArrow(settle, "node long, component long")


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """node, component (the smallest node that it's linked with, itself included) of every node on an edge.

    edges: a, b (long). Rounds of hooking and contraction: every component's root takes the smallest root that an edge
    joins it to as its parent, trees are flattened by pointer jumping, and edges inside a component go. In a round every root that
    has a smaller neighbour goes; each round is written to the shared folder, so lineage stays short. Once `at_once` distinct edges
    or fewer are left, one executor task settles all of them: rounds of many small jobs cost the driver memory, whatever they hold.
    """
    pairs = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct()
    pairs, left = common.written_and_counted(pairs, F.lit(True))
    if 0 < left <= at_once:
        return settled(pairs)
    tree = None
    while left:
        if left <= at_once:
            parent = common.written(settled(pairs).where("node > component").select("node", F.col("component").alias("up")))
        else:
            # A root hooks to a smaller one, so pointers never form a cycle.
            parent = common.written(pairs.groupBy("hi").agg(F.min("lo").alias("up")).select(F.col("hi").alias("node"), "up"))
            while True:
                above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
                parent, moved = common.written_and_counted(parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), F.col("moved"))
                parent = parent.drop("moved")
                if not moved:
                    break
        if tree is None:
            tree = parent
        else:
            step = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            tree = common.written(tree.join(step, "up", "left").select("node", F.coalesce("top", "up").alias("up")).unionByName(parent))
        if left <= at_once:
            break
        for side in ("hi", "lo"):
            step = parent.select(F.col("node").alias(side), F.col("up").alias("top"))
            pairs = pairs.join(step, side, "left").withColumn(side, F.coalesce("top", side)).drop("top")
        pairs = pairs.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi > lo").distinct()
        pairs, left = common.written_and_counted(pairs, F.lit(True))
    if tree is None:
        return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = tree.select(F.col("up").alias("node"), F.col("up").alias("component")).distinct()
    return tree.select("node", F.col("up").alias("component")).unionByName(roots)
