"""Helpers that several corpus operators share: shared-folder tables, id ranges, connected components."""

from __future__ import annotations

import json
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workers

#: Upper bounds of rows and bytes in one Arrow batch sent to Python workers; a text is whole, so one of more bytes is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a local session (one machine, as in tests) gets a temporary folder of its own; on a cluster that is an error, since
    executors would write where others can't read.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='causeway-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Readies the session for Python workers: they find this package, and Arrow batches of whole texts stay small enough for their memory."""
    workers.ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set(_BYTES, str(ARROW_BYTES))


#: Removes the shuffle files of a query when it has ended; what materialize() writes is read from its table, never from these.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: set[str] = set()


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, lost executors lose nothing. discard() or sweep() delete the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/causeway-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.add(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that materialize() wrote, once nothing reads them any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _written.discard(path)


def sweep(spark: SparkSession) -> None:
    """Deletes all tables that materialize() wrote in this process. Call it when the results of the operators have been written or read: they read these tables."""
    discard(spark, *list(_written))


def free_names(df: DataFrame, *names: str) -> dict[str, str]:
    """For each name a column name that df doesn't have, so that helper columns never clash with the caller's."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        made = f"_{name}"
        while made.lower() in taken:
            made = f"_{made}"
        out[name] = made
        taken.add(made.lower())
    return out


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, wherever the expression ends up: also in filters, which repeat what they refer to."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case; every other character stays as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows of ids that may be broadcast after they have been counted: 16 MB.
SMALL = 1_000_000


def sized(ids: DataFrame, most: int = SMALL) -> DataFrame:
    """ids, marked for broadcast if they are `most` rows or fewer, counted here; more of them are left to a shuffled join."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids.hint("merge")


def literal(values: list, kind: str) -> Column:
    """A constant array. It is one literal, so plans stay small."""
    if not values:
        return F.expr(f"cast(array() as array<{kind}>)")
    return F.array(*[F.lit(v).cast(kind) for v in values])


def split_points(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts-1 ascending cut values of an integer column, from a quantile sketch over all rows.

    The list is bounded by `parts`, whatever the number of rows; it is empty for an empty table.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(F.col(column), shares, parts * 20).alias("q")).first()
    return sorted({int(x) for x in (row["q"] or [])})


def range_bucket(value: Column, points: list[int]) -> Column:
    """The number of cut points at or below value, found in two steps of about the square root of their number."""
    if not points:
        return F.lit(0)
    step = max(1, math.isqrt(len(points)))
    runs = [points[i : i + step] for i in range(0, len(points), step)]
    # parsed from one constant: a plan with a node for every point would be slow to make
    heads = F.from_json(F.lit(json.dumps([r[0] for r in runs])), "array<bigint>")
    table = F.from_json(F.lit(json.dumps(runs)), "array<array<bigint>>")
    run = F.size(F.filter(heads, lambda x: x <= value))
    inside = F.size(F.filter(F.element_at(table, F.greatest(run, F.lit(1))), lambda x: x <= value))
    return F.when(run == 0, F.lit(0)).otherwise((run - 1) * step + inside)


#: A node of more edges than this, and than one part in HUBS of all, is a hub; there are 2 * HUBS hubs at most.
HUB, HUBS = 256, 50_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, most: int) -> DataFrame:
    """rows joined with table by key; table has one row per key and, in column n, how many rows have it.

    Keys of more than `most` rows are few, so they are looked up in each task and their rows stay where they are; the others are shuffled. `most` is a part
    in HUBS of all rows or more, which bounds what is broadcast.
    """
    often = F.broadcast(table.where(F.col("n") > most))
    rest = rows.join(often.select(key), key, "left_anti").join(table.where(F.col("n") <= most).hint("merge"), key)
    return rows.join(often, key).unionByName(rest)


def hub_bound(rows: int) -> int:
    """From how many rows on a key of a table of so many rows is a hub."""
    return max(HUB, rows // HUBS)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph, as (node, component); component is the least node that can be reached.

    edges: columns a, b of one orderable type. Rows with a null end and self loops name no link and are ignored, so
    isolated nodes aren't in the result; an empty table gives an empty one. Large-star and small-star steps alternate
    until nothing changes: every step is a grouped minimum (combined before the shuffle) and an equi join in which hubs are looked up from a broadcast table of
    bounded size, so a node with a third of all edges is no single task's work. Each round is written to the shared folder; the one before is deleted.
    """
    spark = edges.sparkSession
    one = F.col("a") > F.col("b")
    start = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.when(one, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(one, F.col("b")).otherwise(F.col("a")).alias("v")).distinct()
    now, path = materialize(start, "edges")

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h"), F.expr("sum(cast(xxhash64(v, u) as decimal(38,0)))").alias("s")).first()
        return r["n"], r["h"], r["s"]

    before = mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        most = hub_bound(before[0])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        star = spread_join(both, least, "u", most).where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = materialize(star, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, "u", most).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = materialize(small, "edges")
        after = mark(new)
        discard(spark, path, large_path)
        now, path = new, new_path
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
