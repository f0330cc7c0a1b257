"""Posts as a stream: new files of a folder are filtered, detected and merged, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..plans import steps
from ..sources import posts as source
from ..sources.database import Database


def ingest(spark: SparkSession, folder: str, db: Database, checkpoint: str, min_score: int = 0, max_files: int = 8, detect=steps.detect, once: bool = True, name: str = "posts", buckets: int = 16) -> StreamingQuery:
    """Starts the stream; once: stop when all files are in.

    A micro-batch is one commit, with its number: a batch that is run again, after a crash or a restart from the checkpoint, finds its number taken and does nothing. It rewrites the buckets of
    posts that it changes only.
    """
    schema = spark.read.parquet(folder).select("*").schema

    def write(batch, number):
        with db.begin() as tx:
            if tx.mark(checkpoint) < number:
                if not tx.has(name):
                    tx.create(name, schemas.POSTS, ["id"], buckets)
                tx.merge(name, schemas.conform(detect(source.qualifying(source.coerce(batch), min_score)), schemas.POSTS))
                tx.set_mark(checkpoint, number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
