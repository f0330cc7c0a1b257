"""Paths between clusters that are named by words: an inverted index of labels and events, and the widest path of few hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Store
from ..functions import text as X
from ..sources.store import settled
from .edges import strong

#: What a word of a label weighs; a word of events weighs 1 for each member that has it.
LABEL = 10
#: The most hops of a path.
HOPS = 6


def word_index(store: Store) -> DataFrame:
    """(word, id, weight): the words of clusters' labels and of their members' events, in lower case. A table of it answers any number of searches."""
    label = store.clusters.select("id", F.explode(F.array_distinct(X.words(F.col("label")))).alias("word")).select("word", "id", F.lit(LABEL).cast("bigint").alias("weight"))
    texts = store.members.groupBy("cluster_id", "event_text").agg(F.count("*").alias("n"))
    event = texts.select(F.col("cluster_id").alias("id"), "n", F.explode(F.array_distinct(X.words(F.col("event_text")))).alias("word")).groupBy("word", "id").agg(F.sum("n").alias("weight"))
    return label.unionByName(event.select(label.columns)).groupBy("word", "id").agg(F.sum("weight").alias("weight"))


def matching(index: DataFrame, query: str) -> DataFrame:
    """(id, weight): the clusters that have every word of a query, with the weights of these words; none for a query without words."""
    words = sorted(set(X.words_of(query)))
    return index.where(F.col("word").isin(words)).groupBy("id").agg(F.count("*").alias("_n"), F.sum("weight").alias("weight")).where(F.col("_n") == len(words)).where(F.lit(bool(words))).select("id", "weight")


def _widths(edges: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """(node, target, hops, width): over walks of exactly so many hops from node to target, the greatest width, which is the least of a walk's post counts. From the targets back, a hop a round."""
    e = edges.select(F.col("source_cluster_id").alias("node"), F.col("target_cluster_id").alias("next"), "post_count")
    now = settled(targets.join(e, F.col("id") == F.col("next")).select("node", F.col("id").alias("target"), F.lit(1).alias("hops"), F.col("post_count").alias("width")), "widths")
    out = now
    for h in range(2, hops + 1):
        step = now.select(F.col("node").alias("next"), "target", "width").join(e, "next").groupBy("node", "target").agg(F.max(F.least("width", "post_count")).alias("width"))
        now = settled(step.select("node", "target", F.lit(h).alias("hops"), "width"), "widths")
        out = out.unionByName(now)
    return out


def widest(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int = 2, min_posts: int = 1) -> DataFrame:
    """(source, target, width, hops, path): for each pair of different nodes of sources and targets (id) that a path joins, the widest; of equal ones the shortest, then the least by its nodes.

    The width of a path is the post count of its weakest edge; edges below min_posts don't count. The frontier goes back from the targets and keeps, for each node and number of hops,
    only how wide it gets; then the sources go forward along edges that keep the width, so no walk is enumerated. Rows grow with nodes times targets, not with paths.
    """
    if not 1 <= max_hops <= HOPS:
        raise ValueError(f"max_hops is 1 to {HOPS}")
    e = settled(strong(edges, min_posts).select("source_cluster_id", "target_cluster_id", "post_count"), "strong")
    back = _widths(e, targets.select("id").distinct(), max_hops)
    met = back.join(sources.select(F.col("id").alias("node")).distinct(), "node").where("node <> target")
    best = met.groupBy("node", "target").agg(F.max(F.struct("width", (-F.col("hops")).alias("less"))).alias("b"))
    walk = best.select(F.col("node").alias("source"), "target", "b.width", (-F.col("b.less")).alias("hops"), "node", F.array("node").alias("path"))
    for at in range(max_hops):
        left = F.col("hops") - at - 1
        ways = walk.where(F.col("hops") > at).withColumn("left", left).join(e.select(F.col("source_cluster_id").alias("node"), F.col("target_cluster_id").alias("next"), "post_count"), "node").where(F.col("post_count") >= F.col("width"))
        rest = back.select(F.col("node").alias("next"), "target", F.col("hops").alias("left"), F.col("width").alias("_wide"))
        on = ways.join(rest, ["next", "target", "left"], "left").where(((F.col("left") == 0) & (F.col("next") == F.col("target"))) | (F.col("_wide") >= F.col("width")))
        step = on.groupBy("source", "target", "width", "hops", "path").agg(F.min("next").alias("node"))
        walk = settled(walk.where(F.col("hops") <= at).unionByName(step.select("source", "target", "width", "hops", "node", F.concat("path", F.array("node")).alias("path"))), "walk")
    return walk.select("source", "target", "width", "hops", "path")


def search(store: Store, edges: DataFrame, cause: str, effect: str, max_hops: int = 2, min_posts: int = 1, index: DataFrame | None = None) -> DataFrame:
    """widest() from the clusters that a cause query names to those that an effect query names, with match: the weights of both ends."""
    index = settled(index if index is not None else word_index(store), "index")
    ends = [settled(matching(index, q), "ends") for q in (cause, effect)]
    a, b = ends[0].select(F.col("id").alias("source"), F.col("weight").alias("_a")), ends[1].select(F.col("id").alias("target"), F.col("weight").alias("_b"))
    return widest(edges, *ends, max_hops, min_posts).join(a, "source").join(b, "target").withColumn("match", F.col("_a") + F.col("_b")).drop("_a", "_b")
