"""Sparse TF-IDF vectors and spherical k-means over them: memory follows the terms that texts have, not the size of the vocabulary."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import workers
from ..functions import text as X
from ..sources.store import settled, spread
from .vectors import let

#: Products of terms and centers that are held at once, in a worker.
CELLS = 1 << 22
_SPACE = "array<int>", "array<double>"


def terms(text: Column) -> Column:
    """Words of two characters or more in lower case, stop words left out, and pairs of words that then stand side by side."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), 0), lambda w: ~w.isin(*X.STOPWORDS))
    both = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.concat(F.element_at(ws, i), F.lit(" "), F.element_at(ws, i + 1)))
    # words are found once, not for each pair
    return let(words, lambda ws: F.concat(ws, F.when(F.size(ws) > 1, both(ws)).otherwise(F.array().cast("array<string>"))))


def _counted(texts: DataFrame, key: str, text: str, max_features: int) -> tuple[DataFrame, list[str], list[float]]:
    """(key, _p) with the ranks and counts (i, n) of each text's terms, by ascending rank, as a table; the terms by rank; and their inverse document frequencies.

    Terms are the max_features most frequent ones, ties by their letters; these come to the driver, as numbers that don't grow with the texts. Only they are counted for each text,
    in the task that the text is dealt to, so terms by text are never shuffled. Texts without one have no rows.
    """
    spark = texts.sparkSession
    words = F.coalesce(terms(F.col(text)), F.array().cast("array<string>"))
    # one null for each text counts the texts; outer generators, here and below, as a filter would be put before others and find the terms twice
    totals = texts.select(F.explode_outer(F.concat(words, F.array(F.lit(None).cast("string")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    top = totals.orderBy(F.col("term").isNotNull(), F.col("n").desc(), "term").limit(max_features + 1).collect()
    rows, names = sum(r["n"] for r in top[:1]), [r["term"] for r in top[1:]]
    vocabulary = F.broadcast(spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "term string, i int"))  # max_features rows
    said = spread(texts.select(key, text), key).select(key, F.explode_outer(terms(F.col(text))).alias("term"))
    each = said.join(vocabulary, "term").groupBy(key, "i").agg(F.count("*").alias("n"))
    packed = settled(each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("_p")), "terms")
    having = {r["i"]: r["n"] for r in packed.select(F.explode("_p.i").alias("i")).groupBy("i").agg(F.count("*").alias("n")).collect()}
    return packed, names, [math.log((1 + rows) / (1 + having[i])) + 1 for i in range(len(names))]


def _unit(packed: DataFrame, idf: list[float]) -> DataFrame:
    """packed with (i, w) for each term in place of its count."""
    by_rank = F.from_json(F.lit(json.dumps(idf)), "array<double>")
    raw = F.transform("_p", lambda p: F.struct(p["i"].alias("i"), ((1 + F.log(p["n"])) * F.get(by_rank, p["i"])).alias("w")))
    length = lambda ps: F.sqrt(F.aggregate(ps, F.lit(0.0), lambda s, p: s + p["w"] * p["w"]))
    scaled = lambda ps: let(length(ps), lambda n: F.transform(ps, lambda p: F.struct(p["i"].alias("i"), (p["w"] / n).alias("w"))))
    return packed.withColumn("_p", let(raw, scaled))


def weighted(texts: DataFrame, key: str = "norm", text: str = "text", max_features: int = 3000) -> DataFrame:
    """(key, i, term, w): the weight of each term in each text that has it, 1 + ln(count) times ln((1 + n) / (1 + df)) + 1, so that the squares of a text's weights add up to 1.

    Terms are the max_features most frequent ones, ties by their letters; i is a term's rank. Texts without one have no rows.
    """
    packed, names, idf = _counted(texts, key, text, max_features)
    table = F.from_json(F.lit(json.dumps(names)), "array<string>")
    return _unit(packed, idf).select(key, F.explode_outer("_p").alias("_p")).select(key, F.col("_p.i").alias("i"), F.get(table, F.col("_p.i")).alias("term"), F.col("_p.w").alias("w"))


def _packed(rows: DataFrame, key: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("i", "w")))
    return _split(rows.groupBy(key).agg(pairs.alias("_p")), key)


def _split(packed: DataFrame, key: str) -> DataFrame:
    return packed.select(key, F.transform("_p", lambda p: p["i"]).cast(_SPACE[0]).alias("idx"), F.transform("_p", lambda p: p["w"]).alias("val"))


def tfidf(texts: DataFrame, key: str = "norm", text: str = "text", max_features: int = 3000) -> DataFrame:
    """(key, idx, val): each text's weighted() terms, by ascending rank, and their weights; empty for texts without."""
    counted, _, idf = _counted(texts, key, text, max_features)
    packed = _split(_unit(counted, idf), key)
    empty = lambda kind: F.array().cast(kind)
    return texts.select(key).join(packed, key, "left").select(key, F.coalesce("idx", empty(_SPACE[0])).alias("idx"), F.coalesce("val", empty(_SPACE[1])).alias("val"))


def dense(space: DataFrame, key: str, size: int) -> DataFrame:
    """(key, vector) of a sparse space, for methods that need every place; size is the vocabulary's."""
    places = F.sequence(F.lit(0), F.lit(size - 1))
    m = F.map_from_arrays("idx", "val")
    return space.select(key, F.transform(places, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))).alias("vector"))


def centers_of(space: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(label, idx, val): the sum of the vectors of each label (key, label), as a unit vector. Sparse rows add up by label and term, combined before the shuffle."""
    flat = space.join(labels, key).select("label", F.explode(F.arrays_zip("idx", "val")).alias("p")).groupBy("label", F.col("p.idx").alias("i")).agg(F.sum("p.val").alias("w"))
    lengths = flat.groupBy("label").agg(F.greatest(F.sqrt(F.sum(F.col("w") * F.col("w"))), F.lit(1e-9)).alias("_l"))
    made = _packed(flat.join(lengths, "label").select("label", "i", (F.col("w") / F.col("_l")).alias("w")), "label")
    return labels.select("label").distinct().join(made, "label", "left").select("label", F.coalesce("idx", F.array().cast(_SPACE[0])).alias("idx"), F.coalesce("val", F.array().cast(_SPACE[1])).alias("val"))


def nearest_center(idx: pa.ListArray, val: pa.ListArray, centers: np.ndarray) -> np.ndarray:
    """The place of the center of greatest dot product for each sparse row, the first of equal ones; 0 for empty rows."""
    sizes = np.diff(idx.offsets.to_numpy())
    at, w = idx.flatten().to_numpy(), val.flatten().to_numpy()
    ends, out = np.concatenate(([0], np.cumsum(sizes))), np.zeros(len(sizes), np.int64)
    step = max(1, CELLS // len(centers))
    row = 0
    while row < len(sizes):
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + step, side="right")) - 1)
        full = np.flatnonzero(sizes[row:to]) + row
        if len(full):
            some = slice(ends[row], ends[to])
            dots = np.add.reduceat(centers[:, at[some]] * w[some], ends[full] - ends[row], axis=1)
            out[full] = dots.argmax(axis=0)
        row = to
    return out


def _matrix(table: pa.Table, size: int) -> np.ndarray:
    out = np.zeros((table.num_rows, size))
    for k, (idx, val) in enumerate(zip(table.column("idx").to_pylist(), table.column("val").to_pylist(), strict=True)):
        out[k, idx] = val
    return out


def spherical(space: DataFrame, key: str, k: int, size: int, seed: int = 42, rounds: int = 10) -> DataFrame:
    """(key, label): k-means by cosine over unit vectors (key, idx, val) of `size` places. Rows without terms get label 0, or the first that is left.

    It begins with the k rows of least hash and seed. A round sends the centers, k times size numbers whatever the rows are many, to the workers; each adds up its rows by center
    and gives the places that are not zero; a grouped sum makes the new centers. A center without rows stays. It ends when nothing moves, or after `rounds`.
    """
    spark = space.sparkSession
    workers.ship(spark)
    order = F.xxhash64(F.col(key), F.lit(seed))
    start = space.where(F.size("idx") > 0).orderBy(order, key).limit(k).select("idx", "val").toArrow()
    if not start.num_rows:
        return space.select(key, F.lit(0).cast("bigint").alias("label"))
    centers = _matrix(start, size)
    k = len(centers)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = shared.value, np.zeros(k * size)
        for b in batches:
            idx, val = b.column("idx"), b.column("val")
            label = np.repeat(nearest_center(idx, val, now), np.diff(idx.offsets.to_numpy()))
            np.add.at(total, label * size + idx.flatten().to_numpy(), val.flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // size), pa.array(at % size), pa.array(total[at])], names=["label", "i", "w"])

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centers)
        found = space.select("idx", "val").mapInArrow(sums, "label bigint, i bigint, w double").groupBy("label", "i").agg(F.sum("w").alias("w")).toArrow()  # k * size rows at most
        label, i, w = (found.column(c).to_numpy() for c in ("label", "i", "w"))
        new = np.zeros_like(centers)
        new[label, i] = w
        lengths = np.linalg.norm(new, axis=1)
        new = np.where(lengths[:, None] > 0, new / np.maximum(lengths, 1e-9)[:, None], centers)
        still = np.allclose(new, centers, atol=1e-9)
        centers = new
        shared.unpersist()
        if still:
            break
    shared = spark.sparkContext.broadcast(centers)

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nearest_center(b.column("idx"), b.column("val"), shared.value))], names=[key, "label"])

    kind = space.schema[key].dataType.simpleString()
    return settled(space.select(key, "idx", "val").mapInArrow(labels, f"`{key}` {kind}, label bigint"), "labels")
