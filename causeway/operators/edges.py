"""Weighted edges between clusters: leaf edges from memberships, and their rollup to any set of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Store
from ..functions.settings import checked
from ..sources.store import spread
from . import tree as T

EDGE = ["source_cluster_id", "target_cluster_id"]


def _met(store: Store, include_no_rel: bool, wide: bool = True) -> DataFrame:
    """pairs() without the posts' scores. Members are pivoted once instead of joined twice; wide: relations meet them in as many tasks as the session shuffles to, so what a task holds grows with the rows alone."""
    relations = store.relations if include_no_rel else store.relations.where("relation_type <> 'no_rel'")
    role = lambda r: F.collect_list(F.when(F.col("role") == r, F.col("cluster_id")))
    ends = store.members.groupBy("relation_id").agg(role("cause").alias("causes"), role("effect").alias("effects"))
    some = relations.select(F.col("id").alias("relation_id"), "post_id", "relation_type")
    joined = (spread(some, "relation_id") if wide else some).join(ends, "relation_id")
    met = joined.withColumn("source_cluster_id", F.explode("causes")).withColumn("target_cluster_id", F.explode("effects"))
    return met.where("source_cluster_id <> target_cluster_id").select(*EDGE, "relation_id", "post_id", "relation_type")


def pairs(store: Store, include_no_rel: bool = True) -> DataFrame:
    """(source_cluster_id, target_cluster_id, relation_id, post_id, score, relation_type): each relation with its cause's and effect's cluster. Several memberships of a role give every combination."""
    return _met(store, include_no_rel, False).join(store.posts.select(F.col("id").alias("post_id"), "score"), "post_id").select(*EDGE, "relation_id", "post_id", "score", "relation_type")


def _weights(met: DataFrame, posts: DataFrame) -> DataFrame:
    """Counts of each edge of _met(). A relation has one post, so what is counted is first brought to a row for each edge, post and relation, where the rows are dealt by post; then rows add up, and only posts are counted as distinct ones."""
    score = F.col("score").cast("double")
    scored = met.join(posts.select(F.col("id").alias("post_id"), "score"), "post_id")
    once = scored.groupBy(*EDGE, "post_id", "relation_id").agg(F.sum(score).alias("_sum"), F.count("score").alias("_scored"), F.count_if(F.col("relation_type") == "countercausal").alias("_refuted"))
    return once.groupBy(*EDGE).agg(F.count("*").alias("relation_count"), F.count_distinct("post_id").alias("post_count"), F.try_divide(F.sum("_sum"), F.sum("_scored")).alias("avg_score"), F.sum("_refuted").cast("bigint").alias("countercausal_count"))


def leaf_edges(store: Store, include_no_rel: bool = True) -> DataFrame:
    """Per ordered pair of clusters: distinct relations, distinct posts, mean score per joined row, countercausal rows. No self edges."""
    return _weights(_met(store, include_no_rel), store.posts)


def strong(edges: DataFrame, min_post_count: int = 1) -> DataFrame:
    return edges.where(F.col("post_count") >= min_post_count)


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes (id)."""
    for end in ("source_cluster_id", "target_cluster_id"):
        edges = edges.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return edges.select("source_cluster_id", "target_cluster_id", "relation_count", "post_count", "avg_score", "countercausal_count")


def _moved(edges: DataFrame, places: DataFrame) -> DataFrame:
    """edges with their ends replaced by the nodes that stand for them; edges that become loops or lose an end are gone."""
    src, tgt = places.select(F.col("node").alias("source_cluster_id"), F.col("target").alias("_s")), places.select(F.col("node").alias("target_cluster_id"), F.col("target").alias("_t"))
    moved = edges.join(src, "source_cluster_id").join(tgt, "target_cluster_id").where("_s <> _t")
    return moved.drop("source_cluster_id", "target_cluster_id").withColumnsRenamed({"_s": "source_cluster_id", "_t": "target_cluster_id"})


def rollup(edges: DataFrame, clusters: DataFrame, nodes: DataFrame, min_post_count: int = 1) -> DataFrame:
    """Leaf edges summed to any set of nodes, levels mixed or not: each leaf counts for the nearest node above it.

    Counts add up, so a post counts once for each leaf edge it is in; the mean is that of leaf means weighted by posts, 0 without posts.
    """
    places = T.nearest(clusters, nodes)
    weight = F.sum("post_count")
    out = _moved(edges, places).groupBy("source_cluster_id", "target_cluster_id").agg(F.sum("relation_count").alias("relation_count"), weight.alias("post_count"), F.coalesce(F.try_divide(F.sum(F.col("avg_score") * F.col("post_count")), weight), F.lit(0.0)).alias("avg_score"), F.sum("countercausal_count").alias("countercausal_count"))
    return strong(out, min_post_count)


def exact_rollup(store: Store, nodes: DataFrame, min_post_count: int = 1, include_no_rel: bool = True) -> DataFrame:
    """As rollup(), but from the relations themselves: distinct relations and posts of each pair of nodes, mean score per row."""
    places = T.nearest(store.clusters, nodes)
    return strong(_weights(_moved(_met(store, include_no_rel), places), store.posts), min_post_count)


def shown(edges: DataFrame) -> DataFrame:
    """Edges as answers have them: source, target, counts, the mean rounded to one digit."""
    return edges.where("source_cluster_id <> target_cluster_id").select(F.col("source_cluster_id").alias("source"), F.col("target_cluster_id").alias("target"), "relation_count", "post_count", F.round(F.coalesce("avg_score", F.lit(0.0)), 1).alias("avg_score"), "countercausal_count")


def level_graph(store: Store, edges: DataFrame, level: int | None = None, min_post_count: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a level, the highest by default."""
    checked(level=level, min_post_count=min_post_count)
    counted = T.member_counts(store.clusters, store.members)
    nodes = T.at_level(counted, level)
    return nodes, rollup(edges, store.clusters, nodes, min_post_count)


def id_list(text: str) -> list[int]:
    """Ids from a comma-separated list; what is no integer is left out, repeats too."""
    out: list[int] = []
    for part in (p.strip() for p in text.split(",")):
        if part.lstrip("-").isdecimal() and part.count("-") <= 1 and int(part) not in out:
            out.append(int(part))
    return out


def expand(store: Store, edges: DataFrame, node: int, context: str = "", min_post_count: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after opening a node: its children, and edges among them and the context nodes. A leaf gives itself and no edges."""
    checked(min_post_count=min_post_count)
    spark = store.clusters.sparkSession
    counted = T.member_counts(store.clusters, store.members)
    below = T.children(counted, node)
    ids = spark.createDataFrame([(i,) for i in id_list(context)], "id bigint")
    inside = below.select("id").unionByName(ids).distinct()
    alone = counted.where(F.col("id") == node).join(T.children(store.clusters, node).select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti")
    return below.unionByName(alone.select(below.columns)), rollup(edges, store.clusters, inside, min_post_count).join(below.select(F.col("parent_id")).limit(1), F.lit(True), "left_semi")


def majority_refuted(edges: DataFrame) -> DataFrame:
    """edges with refuted: more countercausal relations than others."""
    c, r = F.col("countercausal_count"), F.col("relation_count")
    return edges.withColumn("refuted", (c > 0) & (c > r - c))


def two_hops(edges: DataFrame, source: int, target: int, min_post_count: int = 1) -> DataFrame:
    """Paths of one or two edges from source to target: (via, posts), via null for the edge itself; posts is that of the weaker edge. Filters come before the join."""
    e = strong(edges, min_post_count)
    direct = e.where((F.col("source_cluster_id") == source) & (F.col("target_cluster_id") == target)).select(F.lit(None).cast("bigint").alias("via"), F.col("post_count").alias("posts"))
    out = e.where((F.col("source_cluster_id") == source) & (F.col("target_cluster_id") != target)).select(F.col("target_cluster_id").alias("via"), F.col("post_count").alias("_a"))
    into = e.where((F.col("target_cluster_id") == target) & (F.col("source_cluster_id") != source)).select(F.col("source_cluster_id").alias("via"), F.col("post_count").alias("_b"))
    return direct.unionByName(out.join(into, "via").select("via", F.least("_a", "_b").alias("posts")))
