"""Vectors in arrays: means, norms, cosines, nearest centroids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, though body is run for every element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(v: Column) -> Column:
    """v over its length, which counts as 1e-9 at least, so zero vectors stay zero."""
    return let(F.greatest(F.sqrt(dot(v, v)), F.lit(FLOOR)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def means(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, vector): the mean of each group's vectors. Elements are averaged by place, combined before the shuffle."""
    flat = df.select(group, F.posexplode(vector).alias("i", "x"))
    each = flat.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(vector))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    return means(df, group, vector).withColumn(vector, unit(F.col(vector)))


def nearest(df: DataFrame, key: str, vector: str, centers: DataFrame, group: str, most: int = 10_000) -> DataFrame:
    """(key, group, cosine): the centroid of greatest cosine for each vector, the least group among equals.

    Up to `most` centroids are gathered into one row that every vector is compared with inside its own task: no row is paired. More are dealt to blocks of about half as many; the vectors are
    compared with one block after the other, and the best of all blocks counts, so results don't depend on `most`.
    """
    blocks = max(1, -(-2 * n // most)) if (n := centers.count()) > most else 1
    best = None
    for b in range(blocks):
        some = centers if blocks == 1 else centers.where(F.pmod(F.xxhash64(group), F.lit(blocks)) == b)
        table = some.select(F.struct(F.col(group).alias("g"), unit(F.col(vector)).alias("c")).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("_all"))
        against = let(unit(F.col(vector)), lambda u: F.transform("_all", lambda s: F.struct(dot(u, s["c"]).alias("cosine"), (-s["g"]).alias("k"))))
        scored = df.crossJoin(F.broadcast(table)).select(key, against.alias("_s"))  # one row
        found = scored.select(key, F.array_max("_s").alias("b"))
        best = found if best is None else best.unionByName(found)
    if blocks > 1:
        best = best.groupBy(key).agg(F.max("b").alias("b"))
    return best.where("b is not null").select(key, (-F.col("b.k")).alias(group), F.col("b.cosine").alias("cosine"))
