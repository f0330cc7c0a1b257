"""Reading posts: pruned columns, coerced values, title and score filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("id", "title", "score", "num_comments", "created_utc", "author", "url", "permalink")
#: Titles of so many characters or fewer, white space at the ends not counted, are no claims.
SHORT = 10


def stripped(column) -> F.Column:
    """Without white space at either end; unlike trim(), of every Unicode kind."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def coerce(df: DataFrame) -> DataFrame:
    """The eight columns with falsy values settled: numbers that are null, empty or no numbers are 0; empty optional strings are null. Missing columns count as null."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None)
    number = lambda c: F.coalesce(have(c).try_cast("bigint"), F.lit(0).cast("bigint")).alias(c)
    optional = lambda c: F.nullif(have(c).cast("string"), F.lit("")).alias(c)
    return df.select(have("id").cast("string").alias("id"), have("title").cast("string").alias("title"), *[number(c) for c in COLUMNS[2:5]], *[optional(c) for c in COLUMNS[5:]])


def qualifying(df: DataFrame, min_score: int = 0) -> DataFrame:
    """Posts whose score is at least min_score (null counts as 0) and whose title is long enough."""
    score = F.col("score") >= min_score if min_score > 0 else F.coalesce("score", F.lit(0)) >= min_score
    return df.where(score).where(F.length(stripped(F.col("title"))) > SHORT)


def read_posts(spark: SparkSession, path: str, min_score: int = 0) -> DataFrame:
    """Posts from Parquet. Column selection and the score filter reach the scan."""
    raw = spark.read.parquet(path)
    kept = raw.select(*[c for c in COLUMNS if c in raw.columns])
    kept = kept.where(F.col("score") >= min_score) if min_score > 0 and "score" in raw.columns else kept
    return qualifying(coerce(kept), min_score)


def count(spark: SparkSession, path: str) -> int:
    """All rows, unfiltered; no column is read but what the footers hold."""
    return spark.read.parquet(path).count()


def sample(posts: DataFrame, n: int = 100) -> DataFrame:
    """The first n qualifying posts by id."""
    return posts.orderBy("id").limit(n)
