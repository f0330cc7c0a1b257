"""Trees, edges, views and the store on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from causeway import schemas
from causeway.fixtures import Store
from causeway.operators import edges as E
from causeway.operators import evidence as V
from causeway.operators import tree as T
from causeway.operators import views as G
from causeway.sources import posts as P
from causeway.sources import store as D


@pytest.fixture(scope="module")
def small(spark):
    clusters = spark.createDataFrame([(1, "a", 0, 10), (2, "b", 0, 10), (3, "c", 0, 11), (10, "x", 1, 20), (11, "y", 1, 20), (20, "top", 2, None), (4, "orphan", 0, 99)], "id long, label string, level int, parent_id long")
    posts = spark.createDataFrame([("p", "A title", 10), ("q", "Another", 20), ("r", "None", 5)], "id string, title string, score long")
    relations = spark.createDataFrame([(1, "p", "u", "v", "causal"), (2, "p", "u", "w", "countercausal"), (3, "q", "u", "v", "no_rel")], "id long, post_id string, cause_text string, effect_text string, relation_type string").withColumns({"cause_canonical": F.lit(""), "effect_canonical": F.lit("")})
    members = spark.createDataFrame([(1, 1, "cause", "u"), (3, 1, "effect", "v"), (1, 2, "cause", "u"), (3, 2, "effect", "w"), (2, 3, "cause", "u"), (2, 3, "effect", "v")], "cluster_id long, relation_id long, role string, event_text string")
    return Store(posts, relations, clusters, members)


def test_closure_and_cycles(spark, small, rows):
    assert (1, 20, 2) in rows(T.closure(small.clusters)) and (4, 99, 1) in rows(T.closure(small.clusters))
    ring = spark.createDataFrame([(1, 2), (2, 1)], "id long, parent_id long")
    assert rows(T.closure(ring)) == [(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, 0)]


def test_nearest_prefers_the_lower_node(spark, small, rows):
    nodes = spark.createDataFrame([(10,), (1,), (20,)], "id long")
    assert rows(T.nearest(small.clusters, nodes)) == [(1, 1), (10, 10), (11, 20), (2, 10), (20, 20), (3, 20)]


def test_leaf_edges_and_rollup(spark, small, rows):
    leaf = E.leaf_edges(small)
    assert rows(leaf) == [(1, 3, 2, 1, 10.0, 1)]  # two relations of one post; the self edge of relation 3 is gone
    nodes = T.at_level(small.clusters, 1)
    assert rows(E.rollup(leaf, small.clusters, nodes).select("source_cluster_id", "target_cluster_id", "post_count", "avg_score")) == [(10, 11, 1, 10.0)]
    assert E.rollup(leaf, small.clusters, nodes, 2).count() == 0
    assert rows(E.exact_rollup(small, nodes).select("source_cluster_id", "target_cluster_id", "relation_count")) == [(10, 11, 2)]
    assert E.rollup(leaf, small.clusters, T.at_level(small.clusters)).count() == 0  # one top node


def test_expand_leaf_is_itself(spark, small):
    nodes, edges = E.expand(small, E.leaf_edges(small), 1, "3")
    assert [r.id for r in nodes.collect()] == [1] and edges.count() == 0


def test_pages_and_detail(spark, small):
    assert V.cluster_posts(small, 1).select("id", "relation_id").collect() == [("p", 1)]
    assert V.cluster_posts(small, 10).count() == 0 and V.cluster_posts(small, 10, descend=True).count() == 2
    assert V.edge_posts(small, 10, 11).count() == 1
    with pytest.raises(ValueError):
        V.cluster_posts(small, 1, limit=0)
    nested = {r.id: len(r.relations) for r in V.with_relations(small, small.posts).collect()}
    assert nested == {"p": 2, "q": 1, "r": 0}
    detail = V.cluster_detail(small, 10).first()
    assert len(detail.children) == 2 and detail.member_count == 4
    assert V.one_post(small, "r").first().relation_id is None and V.one_post(small, "z").count() == 0


def test_views(spark, small, rows):
    e = spark.createDataFrame([(1, 2, 3, 3, 1.0, 2), (2, 3, 4, 1, 1.0, 0)], schemas.LEAF_EDGES)
    assert [r.refuted for r in E.majority_refuted(e).orderBy("source_cluster_id").collect()] == [True, False]
    assert rows(G.degrees(e)) == [(1, 1), (2, 2), (3, 1)]
    assert rows(G.flows(e)) == [(1, 0, 3, 3), (2, 3, 1, 3), (3, 1, 0, 1)]
    assert G.statistics(e.limit(0), 0).first().density == 0.0
    spans = spark.createDataFrame([([(0, 5), (3, 8), (5, 9), (2, 3)],)], "s array<struct<start: int, end: int>>")
    assert [tuple(x) for x in spans.select(G.without_overlap(F.col("s"))).first()[0]] == [(0, 5), (5, 9)]
    assert E.id_list("1, x,-2,1,--3") == [1, -2]


def test_store(spark, rows, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v long")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v long")
    assert rows(D.upserted(old, new)) == [("a", 1), ("b", 3), ("c", 4)]
    assert rows(D.numbered(new, ["id"], 5, "n").select("id", "n")) == [("b", 6), ("c", 7)]
    t = D.Tables(spark, str(tmp_path))
    assert t.read("posts") is None
    t.overwrite("x", old)
    t.overwrite("x", new)
    assert rows(t.read("x")) == [("b", 3), ("c", 4)]
    t.clear("x")
    assert t.read("x").count() == 0
    run = t.log("detect", "regex", "running", rows_in=5)
    t.log("detect", "regex", "failed", run, error="no")
    last = t.runs().first()
    assert (last.status, last.error_msg, last.rows_in) == ("failed", "no", 5) and last.finished_at >= last.started_at


def test_reading(spark, rows):
    raw = spark.createDataFrame([(1, "  ten chars ", None, ""), (2, "eleven char", "x", "me"), (3, None, "7", "me"), (4, "  eleven char\t", "3", None)], "id long, title string, score string, author string")
    kept = P.qualifying(P.coerce(raw)).select("id", "score", "author")
    assert rows(kept) == [("2", 0, "me"), ("4", 3, None)]
    assert rows(P.qualifying(P.coerce(raw), 1).select("id")) == [("4",)]
    assert P.coerce(raw.select("id", "title")).columns == list(P.COLUMNS)


def test_conform(spark):
    legacy = spark.createDataFrame([(1, "p", 1), (2, "p", 0)], "id long, post_id string, is_countercausal int")
    assert [r.relation_type for r in schemas.conform(legacy, schemas.RELATIONS).orderBy("id").collect()] == ["countercausal", "causal"]


def test_leaf_edges_hold_rows_in_bounded_tasks(spark, small, rows):
    """No row is tripled for two distinct counts, and relations meet members in as many tasks as the session shuffles to, whatever the bytes."""
    plan = E.leaf_edges(small)._jdf.queryExecution().toString()
    assert "Expand" not in plan and "REPARTITION_BY_NUM" in plan
    twice = small.members.unionByName(spark.createDataFrame([(1, 1, "cause", "again"), (2, 1, "cause", "u")], small.members.schema))
    posts = small.posts.withColumn("score", F.when(F.col("id") != "q", F.col("score")))
    many = Store(posts, small.relations, small.clusters, twice)
    assert rows(E.leaf_edges(many)) == [(1, 3, 2, 1, 10.0, 1), (2, 3, 1, 1, 10.0, 0)]
    moved = many.members.where("relation_id <> 3").unionByName(spark.createDataFrame([(2, 3, "cause", "u"), (3, 3, "effect", "v")], small.members.schema))
    assert rows(E.leaf_edges(Store(posts, small.relations, small.clusters, moved)))[1] == (2, 3, 2, 2, 10.0, 0)


def test_relations_of_a_page_are_filtered_before_anything_else(spark, small, rows):
    """The ids of a page are constants below the grouping that makes the relations."""
    made = small.relations.groupBy("post_id", "id", "cause_text", "effect_text", "cause_canonical", "effect_canonical").agg(F.max("relation_type").alias("relation_type"))
    view = Store(small.posts, made, small.clusters, small.members)
    page = V.edge_posts(view, 10, 11)
    assert "post_id#" in (plan := page._jdf.queryExecution().optimizedPlan().toString()) and plan.index("Aggregate") < plan.index(" = p)")
    assert rows(V.page_with_relations(view, small.posts.where("id <> 'q'"))) == rows(V.with_relations(view, small.posts.where("id <> 'q'")))
    assert V.page_with_relations(view, small.posts.limit(0)).count() == 0
    assert str(V.with_relations(view, small.posts)._jdf.queryExecution().optimizedPlan().toString()).count("relation_id#") and len(V.relations_of(view, small.posts).collect()) == 3


def test_all_relations_of_posts_are_made_once(spark, small):
    """Members are not filtered by relations that are made a second time for it."""
    plan = V.relations_of(small, small.posts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 1 and plan.count("Distinct") == 0
