"""Walks up forests by doubling: every round doubles how far each node sees, so a tree of any depth takes as many rounds as its depth has binary digits.

A forest is a table (node, up): each node once, with its parent or null; nodes may be of any orderable type, structs too. Every round is a join and a grouped sum over one row per
node, written to the shared folder of the session, so nothing grows with the number of pairs and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.store import dropped, settled

def _counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df as a table, and how many of its rows still have a way up: counted while it is written."""
    seen = Observation()
    out = settled(df.observe(seen, F.count("up").alias("walking")), name)
    return out, seen.get["walking"]


_HOW = {"sum": F.sum, "max": F.max, "min": F.min}


def forest(df: DataFrame, node: str = "id", up: str = "parent_id", *more: str) -> DataFrame:
    """(node, up, ...) of a table with parent pointers: of rows that repeat a node the least counts, self pointers and parents that don't exist end the walk."""
    rows = df.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(F.when(F.col(up) != F.col(node), F.col(up))).alias("up"), *[F.min(c).alias(c) for c in more])
    known = rows.select(F.col("node").alias("up"), F.lit(True).alias("_known"))
    return rows.join(known, "up", "left").select("node", F.when(F.col("_known"), F.col("up")).alias("up"), *more)


def rings(links: DataFrame) -> DataFrame:
    """(node, ring): the nodes on cycles of links (node, up), with the least node of their cycle. It is empty for a forest.

    Nodes whose walk ends drop out, in as many rounds as their depth has digits. If any stay, the walk goes on until it is longer than they are many: then each stands on a cycle and
    has seen all of it.
    """
    now, left = _counted(links.where(F.col("up").isNotNull()).select("node", "up", F.col("node").alias("least")), "ring")
    reach, steady = 1, False
    while left and not (steady and reach > left):
        on = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("least").alias("_least"))
        new, count = _counted(now.join(on, "up").select("node", F.col("_up").alias("up"), F.least("least", "_least").alias("least")), "ring")
        dropped(now)
        now, left, reach, steady = new, count, reach * 2, count == left
    on_ring = now.select(F.col("up").alias("node")).distinct()
    return now.join(on_ring, "node").select("node", F.col("least").alias("ring"))


def nearest(links: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, target): each node of links (node, up) with the first of itself and those above it that is in marked (node); nodes without one are left out.

    A walk that ends in a cycle without a marked node ends as soon as a round brings nothing new: whatever stands nearer to a marked node or to a root was settled before.
    """
    hit = marked.select("node", F.lit(True).alias("_hit")).distinct()
    start = links.join(hit, "node", "left").select("node", F.when(F.col("_hit"), F.col("node")).alias("target"), F.when(F.col("_hit").isNull(), F.col("up")).alias("up"))
    now, walking = _counted(start, "nearest")
    while walking:
        on = now.select(F.col("node").alias("up"), F.col("target").alias("_target"), F.col("up").alias("_up"))
        # who has arrived, or has no way on, has up null and joins nothing
        new, left = _counted(now.join(on, "up", "left").select("node", F.coalesce("target", "_target").alias("target"), F.when(F.col("target").isNull() & F.col("_target").isNull(), F.col("_up")).alias("up")), "nearest")
        dropped(now)
        now = new
        if left == walking:
            break
        walking = left
    return now.where("target is not null").select("node", "target")


def accumulated(rows: DataFrame, value: str, how: str = "sum") -> DataFrame:
    """(node, value): for each node of rows (node, up, value) the sum, max or min of the values of itself and of all below it. Nodes on a cycle are all below each other; null values don't count."""
    now, walking = _counted(rows.select("node", "up", F.col(value).alias("v")), "totals")
    while walking:
        # v covers what is less than a step below; the nodes a step below have covered the next stretch
        below = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(_HOW[how]("v").alias("_v"))
        on = now.where("up is not null").select(F.col("node").alias("up"), F.col("up").alias("_up"))
        joined = now.join(on, "up", "left").join(below, "node", "left")
        merged = {"sum": F.coalesce(F.col("v") + F.col("_v"), "v", "_v"), "max": F.greatest("v", "_v"), "min": F.least("v", "_v")}[how]
        new, left = _counted(joined.select("node", F.col("_up").alias("up"), merged.alias("v")), "totals")
        dropped(now)
        now = new
        if left == walking:
            dropped(now)
            return _around(rows, value, how)
        walking = left
    return now.select("node", F.col("v").alias(value))


def _around(rows: DataFrame, value: str, how: str) -> DataFrame:
    """accumulated() of rows with cycles: each cycle is cut above its least node, whose total is then that of all its nodes."""
    around = settled(rings(rows), "rings")
    cut = rows.join(around, "node", "left").select("node", F.when(F.col("ring").isNull() | (F.col("ring") != F.col("node")), F.col("up")).alias("up"), value)
    totals = settled(accumulated(cut, value, how), "totals")
    of_ring = around.join(totals.withColumnRenamed("node", "ring"), "ring").select("node", F.col(value).alias("_v"))
    return totals.join(of_ring, "node", "left").select("node", F.coalesce("_v", value).alias(value))


def ancestors(links: DataFrame) -> DataFrame:
    """(node, ancestor, depth): each node with itself at depth 0 and all above it, at their least depth. Its rows are as many as the depths of all nodes add up to: for walks ask nearest()."""
    ringed = not rings(links).isEmpty()
    pairs = settled(links.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")), "pairs")
    jumps = settled(links.where("up is not null").select("node", "up"), "jumps")
    reach, seen = 1, pairs.count()
    while not jumps.isEmpty():
        far = jumps.join(pairs.select(F.col("node").alias("up"), "ancestor", "depth"), "up").select("node", "ancestor", (F.col("depth") + reach).alias("depth"))
        both = pairs.unionByName(far)
        if ringed:
            both = both.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        new = settled(both, "pairs")
        dropped(pairs)
        pairs = new
        if ringed:
            count = pairs.count()
            if count == seen:
                break
            seen = count
        on = jumps.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        further = settled(jumps.join(on, "up").select("node", F.col("_up").alias("up")), "jumps")
        dropped(jumps)
        jumps, reach = further, reach * 2
    dropped(jumps)
    return pairs
