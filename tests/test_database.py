"""Bucketed tables, commits over several of them, and the leaf edges that are kept up to date."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from causeway.fixtures import Store
from causeway.operators import doubling
from causeway.operators import edges as E
from causeway.operators import maintenance, paths
from causeway.operators import tree as R
from causeway.sources import database
from causeway.sources.database import Conflict, Database


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def kv(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def files(tmp_path, name):
    return {str(p.relative_to(tmp_path)) for p in (tmp_path / "db" / name).rglob("*.parquet")}


def table(db, spark, rows, name="t", buckets=8):
    with db.begin() as tx:
        tx.create(name, kv(spark, []).schema, ["k"], buckets)
        tx.merge(name, kv(spark, rows))


def test_merge_rewrites_what_it_touches(spark, db, rows, tmp_path):
    table(db, spark, [(i, "old") for i in range(100)])
    before = files(tmp_path, "t")
    with db.begin() as tx:
        touched = tx.merge("t", kv(spark, [(7, "new"), (8, "old")]), spark.createDataFrame([(9,), (1000,)], "k long"))
    assert len(touched) == 2 and len(files(tmp_path, "t") - before) == 2
    assert rows(db.read("t")) == sorted([(i, "new" if i == 7 else "old") for i in range(100) if i != 9], key=repr)
    # again: nothing changes, nothing is written, there is no commit
    last, now = db.version(), files(tmp_path, "t")
    with db.begin() as tx:
        assert tx.merge("t", kv(spark, [(7, "new"), (8, "old")]), spark.createDataFrame([(9,), (1000,)], "k long")) == set()
    assert db.version() == last and files(tmp_path, "t") == now
    # older versions stay readable until they are removed
    assert db.read("t", 1).where("v = 'new'").count() == 0
    assert db.vacuum(keep=1, hours=0) == 2 and rows(db.read("t").where("k = 7")) == [(7, "new")]
    with db.begin() as tx:
        tx.update("t", kv(spark, [(1, None), (2, "two"), (5000, "none")]), ["v"])
    assert rows(db.read("t").where("k in (1, 2, 5000)")) == [(1, "old"), (2, "two")]


def test_keys_of_several_rows_and_nulls(spark, db, rows):
    table(db, spark, [(1, "a"), (1, "b"), (2, None)])
    with db.begin() as tx:
        assert tx.merge("t", kv(spark, [(1, "b"), (1, "a"), (2, None)])) == set()
        assert len(tx.merge("t", kv(spark, [(1, "b"), (1, "b")]))) == 1
    assert rows(db.read("t")) == [(1, "b"), (1, "b"), (2, None)]
    with db.begin() as tx:
        tx.merge("t", gone=spark.createDataFrame([(1,), (2,)], "k long"))
    assert db.read("t").count() == 0 and db.read("t").columns == ["k", "v"]
    with pytest.raises(ValueError):
        db.begin().create("t", kv(spark, []).schema, ["k"])
    with pytest.raises(KeyError):
        db.read("none")


def test_a_writer_that_dies_between_tables_leaves_both(spark, db, rows):
    table(db, spark, [(1, "a")])
    table(db, spark, [(1, "a")], "u")
    with pytest.raises(RuntimeError, match="killed"), db.begin() as tx:
        tx.merge("t", kv(spark, [(1, "b")]))
        raise RuntimeError("killed")
    assert rows(db.read("t")) == rows(db.read("u")) == [(1, "a")]
    with db.begin() as tx:
        tx.merge("t", kv(spark, [(1, "c")]))
        tx.merge("u", kv(spark, [(1, "c")]))
        assert rows(db.read("t")) == [(1, "a")] and rows(tx.read("t")) == [(1, "c")]
    assert rows(db.read("t")) == rows(db.read("u")) == [(1, "c")]
    assert db.vacuum(keep=1, hours=0) == 3  # the dead write and the two first versions
    assert rows(db.read("t")) == [(1, "c")]


def test_two_writers(spark, db, rows):
    table(db, spark, [(i, "old") for i in range(64)], buckets=64)
    state = db.state()["tables"]["t"]["at"]
    by_bucket = {}
    for k in range(64):
        by_bucket.setdefault(next(iter(db._rows(db.state(), "t").where(F.col("k") == k).select(F.pmod(F.xxhash64("k"), F.lit(64))).collect()))[0], []).append(k)
    assert set(map(int, state)) == set(by_bucket)
    (a, *_), (b, *_) = list(by_bucket.values())[:2]
    one, two = db.begin(), db.begin()
    one.merge("t", kv(spark, [(a, "one")]))
    two.merge("t", kv(spark, [(a, "two")]))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    one, two = db.begin(), db.begin()
    one.merge("t", kv(spark, [(a, "first")]))
    two.merge("t", kv(spark, [(b, "second")]))
    assert two.commit() + 1 == one.commit()  # other buckets: both stay
    assert rows(db.read("t").where("v <> 'old'")) == sorted([(a, "first"), (b, "second")])
    # who has read what another changed must not commit on it
    one, two = db.begin(), db.begin()
    one.replace("t", one.read("t").withColumn("v", F.lit("all")))
    two.merge("t", kv(spark, [(a, "late")]))
    two.commit()
    with pytest.raises(Conflict):
        one.commit()


def test_one_file_for_one_writer(spark, db):
    won = []

    def race(i):
        if db.files.create(f"{db.root}/_commits/000000000009.json", f'{{"by": {i}}}'):
            won.append(i)

    threads = [threading.Thread(target=race, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and db.files.text(f"{db.root}/_commits/000000000009.json") == f'{{"by": {won[0]}}}'
    assert list(db.files.names(f"{db.root}/_commits")) == ["000000000009.json"]


def test_batches_look_for_what_they_touch_once(spark, db, rows, monkeypatch):
    """A first load looks for nothing; a later batch goes through the whole members once to find those it touches and once to write their buckets."""
    live, made, reads = maintenance.LiveEdges(db, 1), [], []
    settled, table = maintenance.settled, Database._rows
    monkeypatch.setattr(maintenance, "settled", lambda df, name: made.append(name) or settled(df, name))
    monkeypatch.setattr(Database, "_rows", lambda self, state, name, *more: reads.append(name) or table(self, state, name, *more))
    posts, relations, members = spark.createDataFrame([("p", 4), ("q", 2)], "id string, score bigint"), "id bigint, post_id string, relation_type string", "relation_id bigint, cluster_id bigint, role string"
    ends = lambda *some: spark.createDataFrame([r for i, a, b in some for r in ((i, a, "cause"), (i, b, "effect"))], members)
    live.apply(posts, spark.createDataFrame([(1, "p", "causal"), (2, "q", "causal")], relations), ends((1, 5, 6), (2, 5, 6)))
    assert not {"touched", "was", "before"} & set(made)
    reads.clear()
    live.apply(relations=spark.createDataFrame([(2, "p", "countercausal"), (3, "q", "causal"), (None, "q", "causal")], relations), members=ends((3, 7, 6)), gone=spark.createDataFrame([(1,)], "id bigint"))
    assert reads.count("members") == 2 and reads.count("relations") == 2
    assert rows(live.leaf_edges()) == [(5, 6, 1, 1, 4.0, 1), (7, 6, 1, 1, 2.0, 0)]


def test_edges_follow_changes(spark, db, rows):
    """Random batches of changes: after each, the edges equal those of the whole tables."""
    r, live = random.Random(4), maintenance.LiveEdges(db, 8)
    posts, relations, members = {}, {}, {}
    for batch in range(4):
        new_posts = {f"p{r.randrange(12)}": r.randrange(50) for _ in range(5)}
        new = {i: (i, f"p{r.randrange(12)}", r.choice(("causal", "countercausal", "no_rel"))) for i in (r.randrange(40) for _ in range(14))}
        ends = {i: [(i, r.randrange(4), side) for side in ("cause", "effect") for _ in range(r.choice((1, 1, 2)))] for i in new if r.random() < 0.8}
        gone = [i for i in relations if r.random() < 0.15 and i not in new]
        made = [spark.createDataFrame(list(new_posts.items()), "id string, score bigint"), spark.createDataFrame(list(new.values()), "id bigint, post_id string, relation_type string"), spark.createDataFrame([m for some in ends.values() for m in some], "relation_id bigint, cluster_id bigint, role string"), spark.createDataFrame([(i,) for i in gone], "id bigint")]
        posts |= new_posts
        relations |= new
        members |= ends
        for i in gone:
            relations.pop(i), members.pop(i, None)
        for _ in range(2 if batch == 2 else 1):  # a batch that comes again is known by its number
            done = live.apply(*made, source="s", batch=batch)
        assert bool(done) == (batch != 2)
        whole = Store(spark.createDataFrame(list(posts.items()), "id string, score bigint"), spark.createDataFrame(list(relations.values()), "id bigint, post_id string, relation_type string"), None, spark.createDataFrame([m for some in members.values() for m in some], "relation_id bigint, cluster_id bigint, role string"))
        rounded = lambda df: rows(df.select(*E.leaf_edges(whole).columns[:4], F.round("avg_score", 9), "countercausal_count"))
        assert rounded(live.leaf_edges()) == rounded(E.leaf_edges(whole)) and live.leaf_edges().count()
    # what is so already changes nothing, also without a number
    again = live.apply(*made[:3])
    assert set(again.values()) == {0}
    # one relation touches one share and one edge
    i = next(k for k, m in members.items() if k in relations and {x[1] for x in m if x[2] == "cause"} != {x[1] for x in m if x[2] == "effect"})
    kind = "causal" if relations[i][2] != "causal" else "countercausal"
    one = live.apply(relations=spark.createDataFrame([(i, relations[i][1], kind)], "id bigint, post_id string, relation_type string"))
    assert one["relations"] == 1 and one["edges"] <= 4


# Trees of any depth ---------------------------------------------------------------------------------------------------


def test_deep_chain_counts(spark):
    """5,000 clusters, each below the next, and one member at the bottom."""
    clusters = spark.range(5000).select("id", F.when(F.col("id") < 4999, F.col("id") + 1).alias("parent_id"))
    members = spark.createDataFrame([(0, 1)], "cluster_id long, relation_id long")
    counts = R.member_counts(clusters, members)
    assert counts.agg(F.min("member_count"), F.max("member_count"), F.count("*")).first() == (1, 1, 5000)
    tops = R.nearest(clusters, clusters.where("id in (1000, 4999)"))
    assert {tuple(x) for x in tops.groupBy("target").count().collect()} == {(1000, 1001), (4999, 3999)}


def test_nodes_inside_each_other(spark, rows):
    clusters = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 3), (5, None), (6, 7), (7, 6)], "id long, parent_id long")
    assert rows(R.inside(clusters, 2, 3)) == [(1, 2), (1, 3), (2, 2), (2, 3), (3, 3), (4, 3)]
    assert rows(R.inside(clusters, 5, 5)) == [(5, 5)] and rows(R.inside(clusters, 6, 7)) == [(6, 6), (6, 7), (7, 6), (7, 7)]
    assert rows(R.descendants(clusters, 99)) == []


def plain_walk(up, node):
    seen = []
    while node is not None and node not in seen:
        seen.append(node)
        node = up.get(node)
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_forests_and_cycles_against_plain_walks(spark, rows, seed):
    r = random.Random(seed)
    up = {i: r.choice((None, *range(40))) if r.random() < 0.9 else None for i in range(40)}
    up = {i: None if p == i else p for i, p in up.items()}
    links = spark.createDataFrame(list(up.items()), "node long, up long")
    walks = {i: plain_walk(up, i) for i in up}
    assert rows(doubling.ancestors(links)) == sorted(((i, a, d) for i, w in walks.items() for d, a in enumerate(w)), key=repr)
    marked = set(r.sample(range(40), 4))
    want = {i: next((a for a in w if a in marked), None) for i, w in walks.items()}
    got = doubling.nearest(links, spark.createDataFrame([(m,) for m in marked], "node long"))
    assert rows(got) == sorted(((i, t) for i, t in want.items() if t is not None), key=repr)
    value = {i: r.randrange(100) for i in up}
    valued = links.join(spark.createDataFrame(list(value.items()), "node long, n long"), "node")
    for how, plain in (("sum", sum), ("max", max), ("min", min)):
        want = sorted(((a, plain(value[i] for i in up if a in walks[i])) for a in up), key=repr)
        assert rows(doubling.accumulated(valued, "n", how)) == want
    ring = {i: min(walks[i]) for i in up if up[i] is not None and i in plain_walk(up, up[i])}
    assert rows(doubling.rings(links)) == sorted(ring.items(), key=repr)


# Paths ---------------------------------------------------------------------------------------------------------------


def test_widest_paths_against_all_walks(spark, rows):
    r = random.Random(6)
    edges = {(a, b): r.randint(1, 6) for a in range(8) for b in range(8) if a != b and r.random() < 0.35}
    df = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "source_cluster_id long, target_cluster_id long, post_count long")
    sources, targets = {0, 1, 5}, {5, 6, 7}
    for hops, least in ((1, 1), (3, 2), (4, 1)):
        walks, best = [((s,), 99) for s in sources], {}
        for _ in range(hops):
            walks = [((*p, b), min(w, n)) for p, w in walks for (a, b), n in edges.items() if a == p[-1] and n >= least]
            for p, w in walks:
                if p[-1] in targets and p[0] != p[-1]:
                    key = (p[0], p[-1])
                    best[key] = min(best.get(key, (0, 99, ())), (-w, len(p) - 1, p))
        want = sorted([(s, t, -w, h, list(p)) for (s, t), (w, h, p) in best.items()], key=repr)
        ids = lambda some: spark.createDataFrame([(i,) for i in some], "id long")
        assert rows(paths.widest(df, ids(sources), ids(targets), hops, least)) == want
    with pytest.raises(ValueError):
        paths.widest(df, ids(sources), ids(targets), 9)


def test_a_first_load_compares_nothing_and_a_bucket_has_several_writers(spark, tmp_path, monkeypatch):
    compared = []
    signed = database._signed
    monkeypatch.setattr(database, "_signed", lambda *a: compared.append(1) or signed(*a))
    db = database.Database(spark, f"file://{tmp_path}/first")
    rows = spark.range(1000).selectExpr("id", "id * 2 AS v")
    with db.begin() as tx:
        tx.create("t", rows.schema, ["id"], 2)
        assert tx.merge("t", rows, rows.where("id < 0").select("id")) == {0, 1} and not compared
    with db.begin() as tx:
        assert tx.merge("t", rows.where("id < 10")) == set() and compared
    with db.begin() as tx:
        tx.merge("t", rows.where("id < 10").withColumn("v", -rows.id), rows.where("id = 999").select("id"), differs=True)
    got = {r.id: r.v for r in db.read("t").collect()}
    assert len(got) == 999 and got[7] == -7 and got[10] == 20
    huge = spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "id long, v long")
    assert {r.id: r.s.n for r in database._signed(huge, ["id"], ["id", "v"], "s").collect()} == {1: 2, 2: 1}
