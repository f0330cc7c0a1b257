"""Posts behind clusters and edges, with their relations, sorted and by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Store
from ..sources.store import settled
from . import tree as T

#: Sort keys that callers may name, and the columns they mean.
SORTS = {"score": "score", "date": "created_utc", "comments": "num_comments"}


#: The most posts of a page: what a page looks up is broadcast, so it has a bound.
MOST = 1000


def _page(df: DataFrame, column: str, limit: int, offset: int) -> DataFrame:
    if not 1 <= limit <= MOST or offset < 0:
        raise ValueError(f"limit is 1 to {MOST}, offset at least 0")
    return df.orderBy(F.col(column).desc(), "id").offset(offset).limit(limit)


def member_relations(store: Store, cluster: int, role: str | None = None, descend: bool = False) -> DataFrame:
    """(relation_id): relations with a membership in a cluster; descend: or in one below it."""
    members = store.members.where(F.col("role") == role) if role else store.members
    if descend:
        inside = T.descendants(store.clusters, cluster).select(F.col("id").alias("cluster_id"))
        return members.join(inside, "cluster_id", "left_semi").select("relation_id").distinct()
    return members.where(F.col("cluster_id") == cluster).select("relation_id").distinct()


def edge_relations(store: Store, source: int, target: int) -> DataFrame:
    """(relation_id): relations whose cause is in or below source and whose effect is in or below target; found in one pass over the members."""
    ends = store.clusters.sparkSession.createDataFrame([("cause", source, 1), ("effect", target, 2)], "role string, within bigint, _bit int")
    wanted = T.inside(store.clusters, source, target).join(F.broadcast(ends), "within").select(F.col("id").alias("cluster_id"), "role", "_bit")
    met = store.members.select("relation_id", "cluster_id", "role").join(wanted, ["cluster_id", "role"])
    return met.groupBy("relation_id").agg(F.bit_or("_bit").alias("_bits")).where("_bits = 3").select("relation_id")


def first_relations(store: Store, chosen: DataFrame) -> DataFrame:
    """(post_id, id): of each post the least id among the chosen relations (relation_id). Only ids are shuffled."""
    mine = store.relations.select("id", "post_id").join(chosen.select(F.col("relation_id").alias("id")), "id", "left_semi")
    return mine.groupBy("post_id").agg(F.min("id").alias("id"))


def _ids(page: DataFrame) -> list[str]:
    """The ids of a page's posts, MOST at most."""
    return [r[0] for r in page.select("id").distinct().collect()]


def _of_page(store: Store, ids: list[str]) -> DataFrame:
    """The relations of a page's posts: its ids are constants, so the filter reaches the scan, below whatever the relations are made by for each post."""
    return store.relations.where(F.col("post_id").isin(ids)) if ids else store.relations.limit(0)


def _shown(store: Store, first: DataFrame, column: str, limit: int, offset: int) -> DataFrame:
    """A page of posts by a column, with the texts of their first relations: the page is cut on ids and written, then its relations are looked up."""
    ids = first.select(F.col("post_id").alias("id"), F.col("id").alias("relation_id"))
    page = settled(_page(store.posts.join(ids, "id"), column, limit, offset), "page")
    r = _of_page(store, _ids(page)).select(F.col("id").alias("relation_id"), "cause_text", "effect_text", "relation_type", (F.col("relation_type") == "countercausal").alias("is_countercausal"))
    return F.broadcast(page).join(r, "relation_id").select(*store.posts.columns, "relation_id", "cause_text", "effect_text", "relation_type", "is_countercausal").orderBy(F.col(column).desc(), "id")


def cluster_posts(store: Store, cluster: int, sort: str = "score", limit: int = 20, offset: int = 0, descend: bool = False) -> DataFrame:
    """A page of a cluster's posts, each with its first relation. sort: score, date or comments; anything else means score."""
    return _shown(store, first_relations(store, member_relations(store, cluster, None, descend)), SORTS.get(sort, "score"), limit, offset)


def cluster_total(store: Store, cluster: int, descend: bool = False) -> DataFrame:
    chosen = member_relations(store, cluster, None, descend).withColumnRenamed("relation_id", "id")
    return store.relations.join(chosen, "id", "left_semi").agg(F.count_distinct("post_id").alias("total"))


def edge_posts(store: Store, source: int, target: int, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the posts behind an edge at any levels, by score."""
    return _shown(store, first_relations(store, edge_relations(store, source, target)), "score", limit, offset)


def edge_total(store: Store, source: int, target: int) -> DataFrame:
    chosen = edge_relations(store, source, target).withColumnRenamed("relation_id", "id")
    return store.relations.join(chosen, "id", "left_semi").agg(F.count_distinct("post_id").alias("total"))


def one_post(store: Store, post: str) -> DataFrame:
    """A post with its relation of least id, or with nulls if it has none; no row if there is no such post."""
    first = store.relations.where(F.col("post_id") == post).orderBy("id").limit(1).select("post_id", F.col("id").alias("relation_id"), "cause_text", "effect_text", "relation_type")
    return store.posts.where(F.col("id") == post).join(first, F.col("id") == F.col("post_id"), "left").drop("post_id")


_OF = ("id", "post_id", "cause_text", "effect_text", "cause_canonical", "effect_canonical", "relation_type")


def _ended(relations: DataFrame, members: DataFrame) -> DataFrame:
    """relations with the clusters of their cause and effect, null where there is none."""
    ends = members.groupBy(F.col("relation_id").alias("id")).agg(*[F.min(F.when(F.col("role") == r, F.col("cluster_id"))).alias(f"{r}_cluster_id") for r in ("cause", "effect")])
    return relations.select(*_OF).join(ends, "id", "left")


def _nested(posts: DataFrame, rows: DataFrame) -> DataFrame:
    nested = rows.groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "post_id"]))).alias("relations")).withColumnRenamed("post_id", "id")
    empty = F.array().cast(nested.schema["relations"].dataType)
    return posts.join(nested, "id", "left").withColumn("relations", F.coalesce("relations", empty))


def relations_of(store: Store, posts: DataFrame) -> DataFrame:
    """The relations of posts (id) with the clusters of their cause and effect, null where there is none.

    Relations meet their ends first, then the posts, so that their texts go to their post once, also where they are grouped by it after. For the few posts of a page see page_with_relations().
    """
    return _ended(store.relations, store.members).join(posts.select(F.col("id").alias("post_id")), "post_id", "left_semi").select(*_OF, "cause_cluster_id", "effect_cluster_id")


def with_relations(store: Store, posts: DataFrame) -> DataFrame:
    """posts with an array of their relations in order of id, empty for those that have none."""
    return _nested(posts, relations_of(store, posts))


def page_with_relations(store: Store, page: DataFrame) -> DataFrame:
    """As with_relations(), for the posts of a page, MOST at most: only their relations are read, and only these relations' members are grouped."""
    page = settled(page, "page")
    mine = settled(_of_page(store, _ids(page)).select(*_OF), "relations")
    members = store.members.join(mine.select(F.col("id").alias("relation_id")), "relation_id", "left_semi")
    return _nested(page, _ended(mine, members))


def refuted(posts_with_relations: DataFrame) -> DataFrame:
    """with_relations() plus refuted: some relation is countercausal."""
    return posts_with_relations.withColumn("refuted", F.exists("relations", lambda r: r["relation_type"] == "countercausal"))


def top_events(store: Store, cluster: int, n: int = 20, descend: bool = False) -> DataFrame:
    """The n most frequent event texts of a cluster; ties by text."""
    members = store.members.where(F.col("cluster_id") == cluster)
    if descend:
        inside = T.descendants(store.clusters, cluster).withColumnRenamed("id", "cluster_id")
        members = store.members.join(inside, "cluster_id", "left_semi")
    return members.groupBy("event_text").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "event_text").limit(n)


def cluster_detail(store: Store, cluster: int) -> DataFrame:
    """One row as a page shows it: the cluster, its children, its top 20 events and 10 posts with all their relations; no row if there is no such cluster."""
    counted = T.member_counts(store.clusters, store.members)
    below = T.children(counted, cluster).agg(F.sort_array(F.collect_list(F.struct(F.col("member_count"), "id", "label")), False).alias("children"))
    events = top_events(store, cluster).agg(F.sort_array(F.collect_list(F.struct("n", "event_text")), False).alias("events"))
    page = page_with_relations(store, cluster_posts(store, cluster, limit=10).select("id", "title", "score")).agg(F.sort_array(F.collect_list(F.struct("score", "id", "title", "relations")), False).alias("posts"))
    node = counted.where(F.col("id") == cluster)
    return node.crossJoin(F.broadcast(below)).crossJoin(F.broadcast(events)).crossJoin(F.broadcast(page))  # one row each


def link(permalink, post_id, base: str = "https://example.org"):
    """A post's address: its permalink if it has one, else one made of its id."""
    return F.concat(F.lit(base), F.coalesce(F.nullif(permalink, F.lit("")), F.concat(F.lit("/comments/"), post_id)))
