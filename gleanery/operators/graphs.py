"""Closures, hops, dependency orders, components and shortest paths, as rounds of joins over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpointed


def closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """src, dst: every pair joined by one step or more; cycles end. Paths double in length each round, so the number of rounds
    is the logarithm of the longest path."""
    reached = checkpointed(edges.select("src", "dst").distinct())
    count = reached.count()
    for _ in range(most_rounds):
        further = reached.alias("a").join(reached.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        reached = checkpointed(reached.union(further).distinct())
        now = reached.count()
        if now == count:
            return reached
        count = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, hops: the least number of steps from any root, the roots included at 0."""
    return _spread(edges, roots, None)


def hops(edges: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """The same, up to a number of steps."""
    return _spread(edges, roots, limit)


def _spread(edges: DataFrame, roots: DataFrame, limit: int | None) -> DataFrame:
    seen = frontier = checkpointed(roots.toDF("node").distinct().withColumn("hops", F.lit(0)))
    # Written once, and through inline(): where one end is computed from the other, the optimizer would infer filters of each
    # round's nodes from those of the last, each twice as long (checkpoints keep what it knows).
    steps = checkpointed(edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), "dst")))).distinct())
    k = 0
    while (limit is None or k < limit) and not frontier.isEmpty():
        k += 1
        met = frontier.join(steps, "node").select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(met.join(seen, "node", "left_anti").withColumn("hops", F.lit(k)))
        seen = seen.unionByName(frontier)
        if k % 8 == 0:
            seen = checkpointed(seen)
    return seen


def distances(edges: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """source, node, hops of all nodes within a number of steps of each source (a node by itself), all sources at once."""
    seen = frontier = checkpointed(sources.toDF("node").distinct().select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")))
    steps = edges.select(F.col("src").alias("node"), "dst").distinct()
    for k in range(1, limit + 1):
        met = frontier.join(steps, "node").select("source", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(met.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def dependency_levels(edges: DataFrame) -> DataFrame:
    """node, level: 0 for what depends on nothing, else one more than the deepest prerequisite (src needs dst). Nodes on a
    cycle, and what depends on them, have no level and are left out."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    open_ = checkpointed(nodes)
    needs = edges.select("src", "dst").distinct()
    done, level = None, 0
    while True:
        blocked = needs.join(open_.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        free = checkpointed(open_.join(blocked, "node", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            return done if done is not None else free
        done = free if done is None else done.unionByName(free)
        open_ = checkpointed(open_.join(free, "node", "left_anti"))
        level += 1


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node). Labels spread along edges and then along labels (pointer jumping)."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy(F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("component")))
    while True:
        met = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(met, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("top"))
        step = checkpointed(step.join(up, "component", "left").select("node", F.least("component", F.coalesce("top", "component")).alias("component"), "was"))
        moved = not step.where("component < was").isEmpty()
        labels = step.drop("was")
        if not moved:
            return labels


def shortest_paths(edges: DataFrame, sources: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """node, cost, prev: least total weight from any source, by rounds that relax what the last round improved. Raises if it
    hasn't settled after most_rounds."""
    best = frontier = checkpointed(sources.toDF("node").distinct().select("node", F.lit(0).cast("long").alias("cost"), F.lit(None).cast("long").alias("prev")))
    steps = checkpointed(edges.groupBy("src", "dst").agg(F.min("weight").cast("long").alias("weight")))
    for _ in range(most_rounds):
        met = frontier.withColumnRenamed("node", "src").drop("prev").join(steps, "src").select(F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.col("src").alias("prev"))
        met = met.groupBy("node").agg(F.min(F.struct("cost", "prev")).alias("new")).select("node", "new.cost", "new.prev")
        known = best.select("node", F.col("cost").alias("old"))
        frontier = checkpointed(met.join(known, "node", "left").where("old is null or cost < old").drop("old"))
        if frontier.isEmpty():
            return best
        best = checkpointed(best.join(frontier, "node", "left_anti").unionByName(frontier))
    raise RuntimeError(f"paths haven't settled after {most_rounds} rounds")


def path_steps(best: DataFrame, target: int) -> DataFrame:
    """The path to one node, from its start: step, node, cost. Back-pointers double in reach each round. No rows if it isn't reached."""
    best = checkpointed(best)
    jump = checkpointed(best.where("prev is not null").select("node", F.col("prev").alias("to")))
    found, reach = checkpointed(best.where(F.col("node") == target).select("node", F.lit(0).cast("long").alias("back"))), 1
    while True:
        further = checkpointed(found.join(jump, "node").select(F.col("to").alias("node"), (F.col("back") + reach).alias("back")))
        if further.isEmpty():
            break
        found, reach = found.unionByName(further), 2 * reach
        jump = checkpointed(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("beyond")), "to").select("node", F.col("beyond").alias("to")))
    last = found.agg(F.max("back").alias("last"))
    return found.crossJoin(F.broadcast(last)).select((F.col("last") - F.col("back")).alias("step"), "node").join(best.select("node", "cost"), "node").select("step", "node", "cost")


def subtree(nodes: DataFrame, root: int, id_: str = "id", parent: str = "parent_id") -> DataFrame:
    """A node and all below it, with depth."""
    edges = nodes.where(F.col(parent).isNotNull()).select(F.col(parent).alias("src"), F.col(id_).alias("dst"))
    start = nodes.where(F.col(id_) == root).select(id_)
    return _spread(edges, start, None).withColumnRenamed("hops", "depth")


def ancestors(nodes: DataFrame, leaf: int, id_: str = "id", parent: str = "parent_id") -> DataFrame:
    edges = nodes.where(F.col(parent).isNotNull()).select(F.col(id_).alias("src"), F.col(parent).alias("dst"))
    return _spread(edges, nodes.where(F.col(id_) == leaf).select(id_), None).withColumnRenamed("hops", "height")
