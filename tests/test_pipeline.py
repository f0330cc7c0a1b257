"""The batch pipeline, the stream and the hierarchies from end to end."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causeway import schemas
from causeway.functions.settings import checked
from causeway.plans import hierarchy, linkage, sparse, steps, vectors
from causeway.plans.pipeline import Pipeline
from causeway.sources.database import Database
from causeway.sources.store import Tables
from causeway.streaming.ingest import ingest

THINGS = "noise light heat salt sugar sleep stress exercise smoke rain frost drought".split()
ENDS = "pain joy decay growth weight loss memory decline".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [(f"t{i:03}", f"{THINGS[i % 12]} exposure {'causes' if i % 3 else 'does not cause'} {ENDS[i % 8]} in group {i % 5}", i) for i in range(90)] + [("x", "short", 1), ("y", "Nothing to be said at all", 1)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "id string, title string, score long").repartition(3).write.mode("overwrite").parquet(path)
    return path


@pytest.mark.parametrize("infer", [{"implementation": "tfidf", "max_features": 64, "unknown": 1}, {"implementation": "ward", "sizes": (8, 4, 2), "max_texts": 30}, {"implementation": "density", "min_sizes": (3, 2, 2), "max_texts": 60}])
def test_pipeline(spark, corpus, tmp_path, infer):
    p = Pipeline(spark, str(tmp_path), {"input": corpus, "infer": infer})
    p.run()
    s = p.store()
    assert s.posts.count() == 90 and s.relations.count() == 90 and s.members.count() == 180
    assert [r.n for r in schemas.violations(s.posts, s.relations, s.clusters, s.members).collect()] == [0] * 9
    tops = s.clusters.where("parent_id is null").persist()
    assert {r.level for r in tops.collect()} == {2} and tops.agg(F.sum("member_count")).first()[0] == 180
    runs = {r.step: r for r in p.tables.runs().where("status = 'done'").collect()}
    assert {k: (r.rows_in, r.rows_out) for k, r in runs.items() if k != "infer"} == {"detect": (91, 90), "extract": (90, 90), "canonize": (90, 90)}
    assert runs["infer"].rows_out == s.clusters.count() and all(r.finished_at >= r.started_at for r in runs.values())
    p.run(2)
    assert p.store().relations.count() == 90  # a step run again replaces its table


def test_unknown_implementation():
    with pytest.raises(TypeError):
        steps.build("detect", {"implementation": "none"})


def test_stream(spark, corpus, tmp_path):
    db = Database(spark, f"file://{tmp_path}/t")
    for _ in range(2):
        ingest(spark, corpus, db, str(tmp_path / "c"), max_files=1).awaitTermination()
    assert db.read("posts").count() == 90
    last = db.version()
    # the same files under a new checkpoint say nothing new: commits name their batches, and no bucket
    ingest(spark, corpus, db, str(tmp_path / "d"), max_files=1).awaitTermination()
    assert db.read("posts").count() == 90 and db.version() > last
    assert not any(b for n in range(last + 1, db.version() + 1) for t, b in db.state(n)["wrote"].items() if not t.startswith("mark:"))


@pytest.mark.parametrize("last", [512, 4])
def test_ward_against_plain_search(spark, last):
    """Both by chain and by rounds of reciprocal neighbours."""
    x = np.random.default_rng(0).normal(size=(40, 3))
    groups = [[i] for i in range(40)]
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
    merges = linkage.ward(spark, x, last)
    for n in range(40, 1, -1):
        labels = hierarchy.cuts(merges, 40, [n])[:, 0] if n < 40 else np.arange(40)
        assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist())}
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda t: cost(groups[t[0]], groups[t[1]]))
        assert np.isclose(merges[40 - n][2] ** 2, 2 * cost(groups[i], groups[j]))
        groups[j] += groups.pop(i)
    nested = hierarchy.cuts(merges, 40, [50, 10, 10, 3])
    assert [len(set(c)) for c in nested.T] == [39, 10, 9, 3]
    assert hierarchy.cuts([], 1, [4, 2]).tolist() == [[0, 0]]


def test_ward_by_rounds_equals_chain(spark):
    x = np.random.default_rng(1).normal(size=(300, 8))
    x[40:45] = x[0]  # repeated rows
    fast, plain = linkage.ward(spark, x, 20), linkage.ward(spark, x, 300)
    assert np.allclose([m[2] for m in fast], [m[2] for m in plain])
    same = lambda a: {frozenset(np.flatnonzero(a == k).tolist()) for k in set(a.tolist())}
    for n in (250, 100, 20, 3):
        assert same(hierarchy.cuts(fast, 300, [n])[:, 0]) == same(hierarchy.cuts(plain, 300, [n])[:, 0])


def test_entity_pairs_and_models(spark):
    posts = spark.createDataFrame([("a", "tea and joy", [(0, 3), (8, 11)]), ("b", "x", [(0, 1)])], "id string, title string, e array<struct<start: int, end: int>>")
    pairs = steps.entity_pairs(posts.withColumnRenamed("e", "entities")).select("cause_text", "effect_text", "marked").collect()
    assert sorted(tuple(p) for p in pairs) == [("joy", "tea", "<e1>tea</e1> and <e0>joy</e0>"), ("tea", "joy", "<e0>tea</e0> and <e1>joy</e1>")]
    fixed = lambda m: F.array(F.struct(F.lit("procausal").alias("label"), F.lit(0.7).alias("score")), F.struct(F.when(m.startswith("<e1>"), "no-rel").otherwise("concausal").alias("label"), F.lit(0.9).alias("score")))
    found = steps.extract_with_models(posts, lambda t: F.col("e"), fixed)
    assert [(r.cause_text, r.relation_type, r.confidence) for r in found.collect()] == [("tea", "countercausal", 0.9)]
    kept = steps.detect_with_model(posts, lambda: lambda texts: ["causal" if "tea" in t else "other" for t in texts])
    assert [r.id for r in kept.collect()] == ["a"]


def test_canonize_distinct(spark):
    r = spark.createDataFrame([("T one", "A", "b"), ("T one", "a", "c"), ("T two", "A", "b")], "title string, cause_text string, effect_text string")
    out = steps.canonize_distinct(r, lambda df: df.withColumn("output", F.concat(F.lit('"'), F.upper("span"), F.lit('.\nx'))))
    assert out.count() == 3 and {x.effect_canonical for x in out.collect()} == {"B", "C"}


@pytest.mark.parametrize("most", [10_000, 1])
def test_nearest_centroid(spark, most):
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [2.0, 0.0])], "g int, v array<double>")
    v = spark.createDataFrame([(7, [0.9, 0.1]), (8, [0.0, 0.0]), (9, [-3.0, 1.0])], "k int, v array<double>")
    assert sorted(tuple(r)[:2] for r in vectors.nearest(v, "k", "v", c, "g", most).collect()) == [(7, 0), (8, 0), (9, 2)]
    assert vectors.nearest(v, "k", "v", c.limit(0), "g", most).count() == 0


def plain_tree(x, near, weights):
    """Prim's tree of mutual reachability over all distances."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    order = np.argsort(d, axis=1, kind="stable")
    reached = (np.cumsum(weights[order], axis=1) >= min(near, weights.sum())).argmax(1)
    core = d[np.arange(len(x)), order[np.arange(len(x)), reached]]
    reach, inside, edges = np.maximum(d, np.maximum(core[:, None], core[None])), [0], []
    while len(inside) < len(x):
        rest = [i for i in range(len(x)) if i not in inside]
        at = reach[np.ix_(inside, rest)]
        i, j = np.unravel_index(at.argmin(), at.shape)
        edges.append((float(at[i, j]), inside[i], rest[j]))
        inside.append(rest[j])
    return edges


@pytest.mark.parametrize("heavy", [False, True])
def test_density(spark, heavy):
    r = np.random.default_rng(3)
    spots = [(0, 0), (8, 0), (0, 8), (9, 9)]
    x = np.vstack([r.normal(c, 0.4, size=(25, 2)) for c in spots] + [[[30, 30], [-30, 4]]])
    weights = r.integers(1, 4, len(x)) if heavy else np.ones(len(x), int)
    labels = linkage.density_labels(spark, x, 8, weights=weights)
    tree, plain = linkage.least_tree(spark, x, 8, weights), plain_tree(x, 8, weights)
    assert np.allclose(sorted(e[0] for e in tree), sorted(e[0] for e in plain))
    assert len(set(labels[:100].tolist()) - {-1}) >= 4 and set(labels[100:].tolist()) == {-1}
    for i in range(4):
        others = set(labels[[j for j in range(100) if j // 25 != i]].tolist()) - {-1}
        assert not others & (set(labels[25 * i : 25 * i + 25].tolist()) - {-1})
    assert linkage.density_labels(spark, x[:3], 8).tolist() == [-1] * 3


def test_groups_of_a_tree_by_hand():
    """Two groups of three, joined by a far edge; a point that hangs on one of them; ties join at once."""
    one = np.ones(7, int)
    edges = [(1.0, 0, 1), (1.0, 1, 2), (2.0, 3, 4), (2.0, 4, 5), (9.0, 2, 3), (5.0, 6, 5)]
    assert linkage.condensed(edges, 7, 3, one).tolist() == [0, 0, 0, 1, 1, 1, 1]
    assert linkage.condensed(edges, 7, 4, one).tolist() == [0] * 7  # one side is too small, so there is nothing to split
    assert linkage.condensed([(1.0, 0, 1), (1.0, 2, 3), (1.0, 1, 2)], 4, 2, one[:4]).tolist() == [0] * 4
    assert linkage.condensed([], 0, 2, one[:0]).tolist() == []


def test_density_of_all_texts(spark):
    """Groups and noise that come after the first max_texts texts are kept apart from the groups before."""
    r = np.random.default_rng(5)
    spots = [(0, 0), (50, 0), (0, 50), (50, 50)]
    points = [(f"g{g} {i}", (r.normal(c, 0.3, size=2)).tolist()) for g, c in enumerate(spots) for i in range(30)] + [("far 0", [400.0, 400.0])]
    vector = {t: v for t, v in points}
    relations = spark.createDataFrame([(k, t, points[k - 1][0]) for k, (t, _) in enumerate(points) if k], "id long, cause_norm string, effect_norm string")
    for side in ("cause", "effect"):
        relations = relations.withColumn(f"{side}_text", F.col(f"{side}_norm")).withColumn(f"{side}_canonical", F.col(f"{side}_norm"))
    table = spark.createDataFrame(list(vector.items()), "norm string, vector array<double>")
    _, members = hierarchy.infer_density(relations, lambda df: df.select("norm").join(table, "norm"), min_sizes=(8, 2), max_texts=24)
    assert members.count() == 240
    groups = {}
    for m in members.collect():
        groups.setdefault(m.event_text.split()[0], []).append(m.cluster_id)
    main = {g: max(set(c), key=c.count) for g, c in groups.items()}
    assert len(main) == 5 and len(set(main.values())) == 5
    parts = {g: set(c) - {main["far"]} for g, c in groups.items() if g != "far"}
    assert all(parts.values()) and not any(parts[a] & parts[b] for a in parts for b in parts if a < b)


@pytest.mark.parametrize("max_texts", [70, 30])
def test_ward_links_all_texts(spark, max_texts):
    """The hierarchy doesn't depend on how many texts are one matrix: none goes to a cluster that was made without it."""
    r = np.random.default_rng(11)
    points = {f"t{i:02}": r.normal((9 * (i % 5), 9 * (i % 3)), 2.0, size=2).tolist() for i in range(80)}
    points["t77"] = points["t03"]
    names = list(points)
    relations = spark.createDataFrame([(k + 1, names[k], names[k + 1]) for k in range(0, 80, 2)], "id long, cause_norm string, effect_norm string")
    for side in ("cause", "effect"):
        relations = relations.withColumn(f"{side}_text", F.col(f"{side}_norm")).withColumn(f"{side}_canonical", F.col(f"{side}_norm"))
    table = spark.createDataFrame(list(points.items()), "norm string, vector array<double>")
    x, sizes = np.array(list(points.values())), [17, 9, 4]
    wanted = hierarchy.cuts(linkage.ward(spark, x), 80, sizes)
    clusters, members = hierarchy.infer_ward(relations, lambda df: df.select("norm").join(table, "norm"), tuple(sizes), max_texts)
    up = {c.id: c.parent_id for c in clusters.collect()}
    leaf = {m.event_text: m.cluster_id for m in members.collect()}
    labels = [[leaf[t], up[leaf[t]], up[up[leaf[t]]]] for t in names]
    ids = [sorted(set(c)) for c in zip(*labels, strict=True)]
    assert [[ids[i].index(v) for i, v in enumerate(row)] for row in labels] == wanted.tolist()


def test_linkage_holds_some_rows_at_a_time(spark, monkeypatch):
    """3,000 vectors: all their distances would be 72 MB; a task has 100 kB of them at once."""
    monkeypatch.setattr(linkage, "CELLS", 1 << 14)
    x = np.random.default_rng(9).normal(size=(3000, 4))
    best, cost = linkage.by_rows(spark, 3000, linkage._cheapest, x, np.ones(3000))
    d = linkage.squares(x, np.arange(3000))
    np.fill_diagonal(d, np.inf)
    assert (best == d.argmin(1)).all() and np.allclose(cost, d.min(1))
    assert np.allclose(linkage.squares(x, np.array([5, 7])), ((x[[5, 7]][:, None] - x[None]) ** 2).sum(-1))


def test_writes_that_die_leave_the_version_before(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}")
    tables.overwrite("t", spark.range(3))
    tables.overwrite("t", spark.range(5))
    assert tables.read("t").count() == 5
    # a version without its success marker is not the table, whatever is in it
    spark.range(9).write.parquet(f"file://{tmp_path}/t/000000000003-dead")
    (tmp_path / "t/000000000003-dead/_SUCCESS").unlink()
    assert tables.read("t").count() == 5
    tables.vacuum("t", 1)
    assert len(tables.versions("t")) == 1 and tables.read("t").count() == 5
    assert tables.read("none") is None


def test_sparse_weights_by_hand(spark):
    """Two texts, one term in both: idf is 1 for it and ln(3/2) + 1 for the others; pairs skip stop words."""
    texts = spark.createDataFrame([("a", "Tea and tea cake"), ("b", "the tea"), ("c", "of a")], "norm string, text string")
    got = {(r.norm, r.term): r.w for r in sparse.weighted(texts).collect()}
    n, idf = 3, lambda df: np.log((1 + 3) / (1 + df)) + 1
    raw = {"tea": (1 + np.log(2)) * idf(2), "cake": idf(1), "tea tea": idf(1), "tea cake": idf(1)}
    length = np.sqrt(sum(w * w for w in raw.values()))
    assert n == 3 and got.keys() == {("a", t) for t in raw} | {("b", "tea")} and np.isclose(got["b", "tea"], 1)
    assert all(np.isclose(got["a", t], w / length) for t, w in raw.items())
    packed = {r.norm: (r.idx, r.val) for r in sparse.tfidf(texts).collect()}
    assert packed["c"] == ([], []) and len(packed["a"][0]) == 4 and packed["b"][0] == [0]
    assert {t for _, t in ((r.i, r.term) for r in sparse.weighted(texts, max_features=1).collect())} == {"tea"}
    wide = {r.norm: r.vector for r in sparse.dense(sparse.tfidf(texts, max_features=4), "norm", 4).collect()}
    assert wide["b"] == [1.0, 0.0, 0.0, 0.0] and wide["c"] == [0.0] * 4


def test_terms_by_text_are_not_shuffled(spark):
    """Words are found once for a text, and what is left to do with the weights needs no exchange. Rows of one key are one text, null texts count."""
    texts = spark.createDataFrame([("a", "tea cake"), ("a", "tea"), ("b", "tea"), ("c", None)], "norm string, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(texts.select(sparse.terms(F.col("text")).alias("terms"))).count("regexp_extract_all(") == 1
    made = sparse.weighted(texts, max_features=2)
    assert not any(word in plan(made) for word in ("Join", "Aggregate", "Repartition"))
    got = {(r.norm, r.term): r.w for r in made.collect()}
    tea, cake = (1 + np.log(2)) * (np.log(5 / 3) + 1), np.log(5 / 2) + 1
    assert got.keys() == {("a", "tea"), ("a", "cake"), ("b", "tea")} and np.isclose(got["a", "tea"] / got["a", "cake"], tea / cake) and np.isclose(got["b", "tea"], 1)
    assert sparse.weighted(texts.limit(0)).count() == 0 and sparse.weighted(texts.where("text is null")).count() == 0


def test_spherical_k_means_against_numpy(spark):
    r = np.random.default_rng(2)
    rows = []
    for k in range(120):
        at = sorted(set((r.integers(0, 6, 4) + 6 * (k % 3)).tolist()))
        w = r.random(len(at)) + 0.1
        rows.append((k, at, (w / np.linalg.norm(w)).tolist()))
    rows.append((500, [], []))
    space = spark.createDataFrame(rows, "k long, idx array<int>, val array<double>").repartition(4)
    x = np.zeros((len(rows), 18))
    for i, (_, at, w) in enumerate(rows):
        x[i, at] = w
    order = [q.k for q in space.where("size(idx) > 0").orderBy(F.xxhash64("k", F.lit(42)), "k").limit(5).collect()]
    centers = x[order]
    for _ in range(10):
        label = (x @ centers.T).argmax(1)
        sums = np.array([x[label == j].sum(0) for j in range(5)])
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(lengths > 0, sums / np.maximum(lengths, 1e-9), centers)
    want = {q[0]: int(j) for q, j in zip(rows, (x @ centers.T).argmax(1), strict=True)}
    labels = sparse.spherical(space, "k", 5, 18)
    assert {q.k: q.label for q in labels.collect()} == want
    made = {q.label: q for q in sparse.centers_of(space, labels, "k").collect()}
    full = [j for j in range(5) if j in made]
    assert all(np.allclose(np.array(made[j].val), centers[j, made[j].idx]) for j in full)
    assert sparse.spherical(space.where("k = 500"), "k", 3, 18).collect()[0].label == 0
    # few products are held at once, whatever the batch
    idx, val = pa.array([q[1] for q in rows], pa.list_(pa.int32())), pa.array([q[2] for q in rows], pa.list_(pa.float64()))
    whole, before = sparse.nearest_center(idx, val, centers), sparse.CELLS
    try:
        sparse.CELLS = 20
        assert (sparse.nearest_center(idx, val, centers) == whole).all()
    finally:
        sparse.CELLS = before


def test_extractor_that_fails_loses_its_own_rows(spark):
    posts = spark.createDataFrame([("a", "tea causes joy"), ("b", "bad title"), ("c", "x and y"), ("d", None), ("e", "strange")], "id string, title string")

    def load():
        def find(title):
            if title.startswith("bad"):
                raise ValueError(title)
            return {"x and y": [("x", "y", "causal", 0.5), ("y", "x", "no_rel", 1), ("y", "y", "causal", 1), ("", "y", "causal", 1)], "strange": [("too", "few")]}.get(title, [])

        return find

    found = steps.extract(posts, fallback=lambda rest: steps.extract_with(rest, load, name="mine"))
    assert sorted((r.id, r.cause_text, r.effect_text, r.extractor, r.cause_norm, r.confidence) for r in found.collect()) == [("a", "tea", "joy", "regex", "tea", 1.0), ("c", "x", "y", "mine", "x", 0.5), ("c", "y", "x", "mine", "y", 1.0)]
    built = steps.build("extract", {"implementation": "table", "load": load, "unknown": 1})
    assert {r.id for r in built(posts).collect()} == {"c"}


def test_ranges_of_requests():
    checked(level=10, limit=200)
    for bad in ({"level": 11}, {"level": -1}, {"min_post_count": 0}, {"limit": 0}, {"limit": 201}, {"offset": -1}, {"sort": "title"}):
        with pytest.raises(ValueError):
            checked(**bad)
