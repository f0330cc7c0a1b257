"""The cluster tree: closure, nearest ancestors, counts that add up the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import doubling


def closure(clusters: DataFrame) -> DataFrame:
    """(node, ancestor, depth): every node with itself at depth 0 and all above it, at their least depth; parents that don't exist are ancestors too, as ids.

    Trees of any depth, cycles too: see doubling.ancestors(). It has a row for every pair, so what follows asks for less.
    """
    pairs = doubling.ancestors(doubling.forest(clusters))
    ids = clusters.select(F.col("id").alias("parent_id"))
    strays = clusters.where(F.col("parent_id").isNotNull()).join(ids, "parent_id", "left_anti").select(F.col("id").alias("ancestor"), "parent_id")
    return pairs.unionByName(pairs.join(strays, "ancestor").select("node", F.col("parent_id").alias("ancestor"), (F.col("depth") + 1).alias("depth")))


def nearest(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, target): each node with the nearest of itself and its ancestors that is in nodes (id); nodes without one are left out."""
    return doubling.nearest(doubling.forest(clusters), nodes.select(F.col("id").alias("node")))


def descendants(clusters: DataFrame, node: int) -> DataFrame:
    """(id): a node and all below it."""
    return nearest(clusters, clusters.where(F.col("id") == node)).select(F.col("node").alias("id"))


def inside(clusters: DataFrame, *nodes: int) -> DataFrame:
    """(id, within): every cluster with each of the given nodes that it is, or is below; found in one walk. Given nodes may be below each other."""
    links = doubling.forest(clusters)
    given = links.where(F.col("node").isin(*nodes))
    found = doubling.nearest(links, given.select("node"))
    next_up = given.select("node", F.col("up").alias("_up")).join(found.select(F.col("node").alias("_up"), "target"), "_up").select("node", "target")
    above = {r[0]: r[1] for r in next_up.collect()}  # a row for each given node at most
    pairs = []
    for n in set(nodes):
        at = n
        while at is not None and (n, at) not in pairs:
            pairs.append((n, at))
            at = above.get(at)
    return found.join(F.broadcast(clusters.sparkSession.createDataFrame(pairs, "target bigint, within bigint")), "target").select(F.col("node").alias("id"), "within")


def member_counts(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """clusters with member_count: member rows of the cluster and of all below it, added up the tree; 0 where there are none."""
    own = members.groupBy("cluster_id").agg(F.count("*").alias("n")).withColumnRenamed("cluster_id", "node")
    counted = doubling.forest(clusters).join(own, "node", "left").select("node", "up", F.coalesce("n", F.lit(0)).alias("n"))
    sums = doubling.accumulated(counted, "n").select(F.col("node").alias("id"), F.col("n").cast("bigint").alias("member_count"))
    return clusters.drop("member_count").join(sums, "id")


def level_counts(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("level").agg(F.count("*").alias("n"))


def levels(clusters: DataFrame) -> DataFrame:
    """One row: the levels in order and a map of their counts by name."""
    return level_counts(clusters).agg(F.array_sort(F.collect_list("level")).alias("levels"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("level").cast("string"), "n")))).alias("counts"))


def at_level(clusters: DataFrame, level: int | None = None) -> DataFrame:
    """The clusters of a level, of the highest one if none is given."""
    if level is not None:
        return clusters.where(F.col("level") == level)
    top = clusters.agg(F.max("level").alias("level"))
    return clusters.join(F.broadcast(top), "level", "left_semi")  # one row


def children(clusters: DataFrame, node: int) -> DataFrame:
    return clusters.where(F.col("parent_id") == node)


def with_labels(df: DataFrame, id_column: str, *sources: DataFrame, out: str = "label") -> DataFrame:
    """df with the label of an id; later sources win over earlier ones, and ids that none has are called Cluster <id>."""
    ranked = None
    for i, s in enumerate(sources):
        part = s.select(F.col("id").alias(id_column), F.struct(F.lit(i).alias("rank"), F.col("label")).alias("s"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy(id_column).agg(F.max("s").alias("_s"))
    return df.join(best, id_column, "left").withColumn(out, F.coalesce("_s.label", F.concat(F.lit("Cluster "), F.col(id_column).cast("string")))).drop("_s")


def collapsed(clusters: DataFrame, expanded: DataFrame, node: int) -> DataFrame:
    """(id): what closes with a node: itself and the expanded nodes that are reached from it through expanded nodes only."""
    open_nodes = clusters.join(expanded.select("id").distinct(), "id", "left_semi").select("id", F.when(F.col("id") != node, F.col("parent_id")).alias("parent_id"))
    return descendants(open_nodes, node)


def frontier(clusters: DataFrame, expanded: DataFrame, node: int) -> DataFrame:
    """(id): the nodes in view below a node: from it down through expanded nodes to those that aren't."""
    inside = collapsed(clusters, expanded, node)
    below = clusters.join(inside.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")
    start = clusters.where(F.col("id") == node).select("id")
    return below.unionByName(start).distinct().join(expanded.select("id"), "id", "left_anti")
