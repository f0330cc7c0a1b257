"""Merkle dataset manifest: hash trees over the rows of each group and over the groups, reduced as a sparse forest, with a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Children of a node, fragments that one task of a reduction round merges, and the tree over the groups.
ARITY, FAN, TOP = 16, 16, -1
#: As TOP, for the one row that holds the root of all.
ROOT = -2

_NODES = T.StructType([T.StructField("done", T.BooleanType()), T.StructField("tree", T.LongType()), T.StructField("n", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("idx", T.LongType()), T.StructField("kids", T.ArrayType(T.StringType())), T.StructField("part", T.LongType())])
_KINDS = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int64()]


class Forest:
    """A fragment of all trees: nodes whose sibling run isn't complete yet, by (tree, level, run).

    Fragments form a commutative monoid: to add the nodes of one to another, in any order, gives the fragment of both. The number n of a tree's leaves tells how many siblings every
    run has, so a run that is complete becomes its parent at once, and the root of a group's tree becomes a leaf of TOP.
    """

    def __init__(self, groups: int):
        self.groups, self.open, self.sizes, self.runs = groups, {}, {}, []

    def add(self, tree: int, n: int, level: int, idx: int, digest: str) -> None:
        while True:
            width = -(-n // ARITY**level)
            if width == 1:
                if tree == TOP:
                    self.runs.append((ROOT, 1, 0, 0, [digest]))
                    return
                tree, n, level, idx = TOP, self.groups, 0, tree
                continue
            run = idx // ARITY
            key, arity = (tree, level, run), min(ARITY, width - run * ARITY)
            kids = self.open.setdefault(key, {})
            kids[idx % ARITY] = digest
            self.sizes[tree] = n
            if len(kids) < arity:
                return
            del self.open[key]
            ordered = [kids[i] for i in range(arity)]
            self.runs.append((tree, n, level, run, ordered))
            level, idx, digest = level + 1, run, hashlib.sha256("".join(ordered).encode()).hexdigest()

    def taken(self, part: int, last: bool) -> pa.RecordBatch:
        """The runs completed since the last call, and at the last call also the open nodes."""
        rows = [(True, *r, part) for r in self.runs]
        self.runs = []
        if last:
            rows += [(False, tree, self.sizes[tree], level, run * ARITY + i, [digest], part) for (tree, level, run), kids in self.open.items() for i, digest in kids.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, _KINDS, strict=True)], names=_NODES.names)


def _fragments(groups: int):
    """A task's rows (tree, n, idx, leaf, part) to the runs completed in it and its open nodes, which are few: they stand at the ends of its stretch of leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, part = Forest(groups), None
        for batch in batches:
            for tree, n, idx, leaf, at in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                part = at if part is None else min(part, at)
                forest.add(tree, n, 0, idx, leaf)
            yield forest.taken(part or 0, False)
        yield forest.taken(part or 0, True)

    return run


def _merged(groups: int):
    """The open nodes of FAN neighbouring fragments to those of their sum."""

    def run(table: pa.Table) -> pa.Table:
        forest = Forest(groups)
        for row in table.to_pylist():
            forest.add(row["tree"], row["n"], row["level"], row["idx"], row["kids"][0])
        return pa.Table.from_batches([forest.taken(min(table.column("part").to_pylist()) // FAN, True)])

    return run


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256, as lower-case hex, of the values: each as its number of bytes, a colon and itself, or as a hyphen if null."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def _height(n: Column) -> Column:
    """Levels of runs in a tree of n leaves."""
    return F.size(F.filter(common.literal([ARITY**i for i in range(15)], "bigint"), lambda x: x < n))


def _placed(rows: DataFrame) -> tuple[DataFrame, int, list[str]]:
    """rows (s, order, leaf, ...) with tree (the place of s among all), n (rows of s) and idx (the row's place in s); how many s there are; and tables that this reads.

    The rows are dealt by ranges and counted by range: no task sees more than a range, and no list of groups is collected.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "s", "order", "leaf").sortWithinPartitions("s", "order", "leaf").withColumn("at", F.monotonically_increasing_id())
    dealt, path = common.materialize(dealt.withColumn("part", F.shiftright("at", 33)), "leaves")
    ranges, r_path = common.materialize(dealt.groupBy("s", "part").agg(F.count("*").alias("c"), F.min("at").alias("lo")), "ranges")
    # rows of a group before each of its ranges; groups by the range they begin in
    before = "coalesce(sum(c) OVER (PARTITION BY s ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - lo AS shift"
    begin = ranges.groupBy("s").agg(F.min("part").alias("begins"), F.sum("c").alias("n")).withColumn("rank", F.expr("row_number() OVER (PARTITION BY begins ORDER BY s) - 1"))
    starts = begin.groupBy("begins").agg(F.count("*").alias("k")).selectExpr("begins", "coalesce(sum(k) OVER (ORDER BY begins ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base")  # a row for each range
    groups = begin.join(starts, "begins").select("s", "n", (F.col("base") + F.col("rank")).cast("bigint").alias("tree"))
    places, p_path = common.materialize(ranges.selectExpr("s", "part", before).join(groups, "s"), "places")
    n_groups = places.select("tree").distinct().count()
    out = dealt.join(common.sized(places), ["s", "part"]).withColumn("idx", (F.col("at") + F.col("shift")).cast("bigint")).drop("at", "shift")
    common.discard(rows.sparkSession, r_path)
    return out, n_groups, [path, p_path]


def _reduced(leaves: DataFrame, groups: int) -> DataFrame:
    """All runs of all trees (tree, n, level, idx, kids) and the row of ROOT.

    Each task completes what it can of its leaves; then the fragments of FAN neighbouring parts are merged, round by round, as a tree reduction whose levels
    are written tables: what is open gets fewer with every round, and a lost executor costs one round.
    """
    spark = leaves.sparkSession
    now, _ = common.materialize(leaves.select("tree", "n", "idx", "leaf", "part").mapInArrow(_fragments(groups), _NODES), "forest")
    done = now.where("done")
    for _ in range(20):
        rest = now.where("not done")
        if rest.isEmpty():
            return done.select("tree", "n", "level", "idx", "kids")
        now, _ = common.materialize(rest.groupBy(F.expr(f"part div {FAN}")).applyInArrow(_merged(groups), _NODES), "forest")
        done = done.unionByName(now.where("done"))
    raise RuntimeError("runs of siblings stay incomplete: rows changed while they were read")


def _paths(runs: DataFrame, groups: int) -> DataFrame:
    """Every run with up: the runs above it to the root, nearest first, each with the place that its node has in it.

    From the root down, a join for each level of the trees; a run has ARITY runs below it at most, so no key is hot.
    """
    split = groups > 1
    height, top = _height(F.col("n")), F.col("tree") == TOP
    last = F.col("level") == height - 1
    of_all = F.lit(int(split)) * _height(F.lit(groups).cast("bigint"))
    at = F.when(last & ~top, F.col("tree")).otherwise(F.col("idx"))
    shaped = runs.select("tree", "level", "idx", "kids", F.when(top, height - 1 - F.col("level")).otherwise(of_all + height - 1 - F.col("level")).alias("depth"), F.when(last, F.lit(TOP)).otherwise(F.col("tree")).cast("bigint").alias("up_tree"), F.when(last, F.lit(0)).otherwise(F.col("level") + 1).alias("up_level"), F.floor(at / F.lit(ARITY)).alias("up_idx"), F.pmod(at, F.lit(ARITY)).cast("int").alias("pos"))
    shaped, _ = common.materialize(shaped, "runs")
    deepest = shaped.agg(F.max("depth").alias("d")).first()["d"]
    kind = "array<struct<pos:int,kids:array<string>>>"
    out = now = shaped.where("depth = 0").select("tree", "level", "idx", "kids", F.expr(f"cast(array() as {kind})").alias("up"))
    for d in range(1, (deepest or 0) + 1):
        above = now.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), F.col("kids").alias("_kids"), F.col("up").alias("_up"))
        below = shaped.where(F.col("depth") == d).join(above, ["up_tree", "up_level", "up_idx"])
        now, _ = common.materialize(below.select("tree", "level", "idx", "kids", F.concat(F.array(F.struct("pos", F.col("_kids").alias("kids"))), "_up").cast(kind).alias("up")), "paths")
        out = out.unionByName(now)
    return out


def manifest(df: DataFrame, values: list[str], group: str = "source", key: str = "doc_id", changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """One row per row of df: key, leaf, subroot, root, proof (the hashes beside the row's path, level by level up to the root), folded and verified.

    leaf is leaf_hash() of `values`. The leaves of each group ascend by key, null first, then by hash, so rows that repeat a key have a defined order and equal rows are interchangeable.
    While there are several nodes, every 16 consecutive ones become the hash of their hashes as text. The groups' roots, ordered by group (null first, then by bytes), likewise
    give root. folded is the root as recomputed from the row's own leaf and the proof; where `when` holds, from the leaf of the values that `changed` names. verified: it equals root.
    A group of one row has that row's leaf as its subroot. An empty table gives no rows. Other columns may have any name; they aren't looked at.
    """
    changed, spark = changed or {}, df.sparkSession
    other = leaf_hash([changed.get(c, F.col(c)) for c in values])
    hashed = df.select(F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("s"), F.col(key).alias("order"), leaf_hash([F.col(c) for c in values]).alias("leaf"), (F.when(when, other) if when is not None else F.lit(None).cast("string")).alias("other"))
    hashed, path = common.materialize(hashed, "hashed")
    leaves, groups, _ = _placed(hashed)
    common.discard(spark, path)
    if not groups:
        return df.limit(0).select(key, *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof", "folded")], F.lit(True).alias("verified"))
    nodes = _reduced(leaves, groups)
    root = nodes.where(F.col("tree") == ROOT).select(F.element_at("kids", 1).alias("root"))
    paths = _paths(nodes.where(F.col("tree") != ROOT), groups)
    alone = F.col("n") == 1
    at = F.when(alone, F.col("tree")).otherwise(F.col("idx"))
    placed = leaves.select("order", "leaf", "other", _height(F.col("n")).alias("h"), F.when(alone, F.lit(TOP)).otherwise(F.col("tree")).cast("bigint").alias("tree"), F.floor(at / F.lit(ARITY)).alias("idx"), F.pmod(at, F.lit(ARITY)).cast("int").alias("pos"))
    first = paths.where("level = 0").select("tree", "idx", "kids", "up")
    step = F.filter(F.concat(F.array(F.struct("pos", "kids")), F.coalesce("up", F.expr("cast(array() as array<struct<pos:int,kids:array<string>>>)"))), lambda s: s["kids"].isNotNull())
    joined = placed.join(first.hint("merge"), ["tree", "idx"], "left").crossJoin(F.broadcast(root)).select("order", "leaf", "other", "h", "root", step.alias("steps"))  # one row
    beside = F.array_join(F.flatten(F.transform("steps", lambda s: F.filter(s["kids"], lambda k, i: i != s["pos"]))), "")
    fold = F.aggregate("steps", F.coalesce("other", "leaf"), lambda acc, s: F.sha2(F.array_join(F.transform(s["kids"], lambda k, i: F.when(i == s["pos"], acc).otherwise(k)), ""), 256))
    own = F.get("steps", F.col("h"))
    subroot = F.coalesce(F.get(own["kids"], own["pos"]), F.col("root")) if groups > 1 else F.col("root")
    return joined.select(F.col("order").alias(key), "leaf", subroot.alias("subroot"), "root", beside.alias("proof"), fold.alias("folded")).withColumn("verified", F.col("folded") == F.col("root"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    found = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed={"text": common.ascii_lower(F.col("text"))}, when=hit)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


def _hash_sql(text: str) -> str:
    field = lambda c: f"coalesce(strlen({c})||':'||{c}, '-')"
    return "sha256(" + "||".join(field(c) for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = "xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda z: ascii(z)::ubigint)), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1::ubigint)))), 4294967295::ubigint)"

SQL = f"""WITH RECURSIVE hashed AS MATERIALIZED (SELECT doc_id, source, {_hash_sql('text')} leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_hash_sql(_LOWER)} END other FROM documents),
  leaves AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 idx, count(*) OVER (PARTITION BY source) n FROM hashed),
  nodes(tree, level, idx, h, width) AS (SELECT tree, 0, idx, leaf, n FROM leaves UNION ALL SELECT tree, level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (width + 15) // 16 FROM nodes WHERE width > 1 GROUP BY tree, level, idx // 16, width),
  subroots AS MATERIALIZED (SELECT tree, h FROM nodes WHERE width = 1),
  tops(level, idx, h, width) AS (SELECT 0, tree, h, (SELECT count(*) FROM subroots) FROM subroots UNION ALL SELECT level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (width + 15) // 16 FROM tops WHERE width > 1 GROUP BY level, idx // 16, width),
  runs AS MATERIALIZED (SELECT tree, level, idx // 16 run, list(h ORDER BY idx) kids, CASE WHEN width <= 16 THEN -1 ELSE tree END to_tree, CASE WHEN width <= 16 THEN 0 ELSE level + 1 END to_level, CASE WHEN width <= 16 THEN tree ELSE idx // 16 END to_idx FROM nodes WHERE width > 1 GROUP BY tree, level, idx // 16, width
    UNION ALL SELECT -1, level, idx // 16, list(h ORDER BY idx), -1, level + 1, idx // 16 FROM tops WHERE width > 1 GROUP BY level, idx // 16, width),
  walk(doc_id, leaf, own, tree, level, idx, folded, proof, steps) AS (SELECT doc_id, leaf, tree, CASE WHEN n > 1 THEN tree ELSE -1 END, 0, CASE WHEN n > 1 THEN idx ELSE tree END, coalesce(other, leaf), '', 0 FROM leaves
    UNION ALL SELECT doc_id, leaf, own, to_tree, to_level, to_idx, sha256(array_to_string(list_transform(kids, lambda k, i: CASE WHEN i = idx % 16 + 1 THEN folded ELSE k END), '')), proof || array_to_string(list_filter(kids, lambda k, i: i <> idx % 16 + 1), ''), steps + 1 FROM walk w JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.run = w.idx // 16)
  SELECT doc_id, leaf, s.h subroot, t.h root, sha256(proof) proof_sha256, folded folded_root, folded = t.h verified FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY steps DESC) = 1) w JOIN subroots s ON s.tree = w.own, (SELECT h FROM tops WHERE width = 1) t"""
