"""Tables of the store as Parquet folders: upserts, appends with dense ids, updates by id, run logs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder; on a cluster that is an error, since executors would write where others can't read."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='causeway-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table in the shared folder of spark.checkpoint.dir: plans that use it several times stay small, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table behind what settled() returned, once nothing reads it any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.settled_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df dealt by keys to as many tasks as the session shuffles to. For rows that are small but costly to compute on: few bytes would otherwise be read, or left after a shuffle, as one task's work."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def upserted(old: DataFrame | None, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Rows of both, the last written of each key: new before old; among new ones the greatest `order`, then the greatest row. Only the new rows are grouped; old ones stay where they have no new row."""
    columns = new.columns
    last = F.struct(*([F.col(order)] if order else []), F.struct(*columns).alias("row"))
    newest = new.groupBy(key).agg(F.max(last).alias("_last")).select("_last.row.*")
    return newest if old is None else old.select(columns).join(newest.select(key), key, "left_anti").select(columns).unionByName(newest)


def numbered(new: DataFrame, order: list[str], start: int = 0, id_column: str = "id") -> DataFrame:
    """new with dense ids from start + 1 in the given total order.

    The rows are written, dealt by ranges of the order and written with their range and place in it; a range's first id follows from the counts of those before, one number for
    each range. Ids depend on the written table alone, so whatever runs again gives the same; new itself is computed once.
    """
    spark, rows = new.sparkSession, settled(new, "rows")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    dropped(rows)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    offsets, at = [], start
    for r, n in sorted(tuple(r) for r in dealt.groupBy(part.alias("r")).agg(F.count("*").alias("n")).collect()):
        offsets.append((r, at))
        at += n
    table = F.broadcast(spark.createDataFrame(offsets, "_range bigint, _from bigint"))
    return dealt.withColumn("_range", part).join(table, "_range").withColumn(id_column, (F.col("_from") + place + 1).cast("bigint")).drop("_range", "_from", "_at")


def updated(old: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """old with the columns that changes has for the same key; null there, or no row, keeps the old value."""
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = old.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def resolved(memberships: DataFrame, relations: DataFrame, clusters: DataFrame) -> DataFrame:
    """Memberships by position (relation_index, cluster_index, role, event_text) with the ids that relations and clusters (index, id) give."""
    r = relations.select(F.col("index").alias("relation_index"), F.col("id").alias("relation_id"))
    c = clusters.select(F.col("index").alias("cluster_index"), F.col("id").alias("cluster_id"))
    return memberships.join(r, "relation_index").join(c, "cluster_index").select("cluster_id", "relation_id", "role", "event_text")


class Tables:
    """Parquet tables under one folder. A write goes to a new, numbered version folder, which counts once Spark has put its success marker there: the last such
    version is the table. So readers see whole tables only, and a write that dies leaves the version before. vacuum() deletes old versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[str]:
        """The complete versions of a table, oldest first."""
        folder, fs = self._fs(f"{self.root}/{name}")
        found = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(v for v in found if v[:1].isdigit() and fs.exists(self._fs(f"{self.root}/{name}/{v}/_SUCCESS")[0]))

    def version(self, name: str) -> str | None:
        return (self.versions(name) or [None])[-1]

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame | None:
        version = self.version(name)
        if version is None:
            return None if schema is None else self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def overwrite(self, name: str, df: DataFrame) -> None:
        last = self.version(name)
        number = int(last.split("-")[0]) + 1 if last else 1
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.root}/{name}/{number:012d}-{uuid.uuid4().hex}")

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Deletes all but the last `keep` versions; call it when nothing reads older ones."""
        for version in self.versions(name)[: -max(1, keep)]:
            path, fs = self._fs(f"{self.root}/{name}/{version}")
            fs.delete(path, True)

    def clear(self, *names: str) -> None:
        """Empties tables that exist; they keep their columns."""
        for name in names:
            now = self.read(name)
            if now is not None:
                self.overwrite(name, now.limit(0))

    def upsert_posts(self, posts: DataFrame) -> None:
        self.overwrite("posts", upserted(self.read("posts"), schemas.conform(posts, schemas.POSTS)))

    def log(self, step: str, implementer: str, status: str, run: str | None = None, rows_in: int | None = None, rows_out: int | None = None, error: str | None = None) -> str:
        """Appends an event to the run log; a run's first event gives its id."""
        run = run or uuid.uuid4().hex
        row = self.spark.createDataFrame([(run, step, implementer, rows_in, rows_out, status, error)], "run string, step string, implementer string, rows_in bigint, rows_out bigint, status string, error_msg string")
        row.withColumn("at", F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")).write.mode("append").parquet(f"{self.root}/pipeline_runs")
        return run

    def runs(self) -> DataFrame:
        return latest_runs(self.spark.read.parquet(f"{self.root}/pipeline_runs"))


def latest_runs(events: DataFrame) -> DataFrame:
    """One row per run: when it started and finished, its counts, and the status and error of its last event."""
    last = F.max_by(F.struct("status", "error_msg"), F.struct("at", (F.col("status") != "running").alias("ended")))
    return events.groupBy("run", "step", "implementer").agg(F.min("at").alias("started_at"), F.max(F.when(F.col("status") != "running", F.col("at"))).alias("finished_at"), F.max("rows_in").alias("rows_in"), F.max("rows_out").alias("rows_out"), last.alias("_last")).select("run", "step", "implementer", "started_at", "finished_at", "rows_in", "rows_out", "_last.status", "_last.error_msg")
