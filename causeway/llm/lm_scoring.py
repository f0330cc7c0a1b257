"""LM scoring: the cross-entropy difference of a target and a background n-gram model over one vocabulary, the bytes of UTF-8."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of an n-gram: the last one is the token, those before it its history. 6 bytes fit a 64-bit integer beside a row number.
ORDER = 6
#: What the estimate by the byte before weighs, in occurrences of a history.
MASS = 8.0
#: The most frequent n-grams, so many at most, which tasks hold to spare them the shuffle. Results are the same without.
HOT = 1 << 19
#: Positions that are counted at once, distinct n-grams that a task holds before it sends them on, and rows that it sends at once.
SLICE, KEEP, CHUNK = 1 << 21, 1 << 21, 1 << 15
_BITS = 8 * ORDER
_LOW = (1 << _BITS) - 1


def slices(texts: list[str]) -> Iterator[np.ndarray]:
    """The n-grams of a list of texts, as integers: the number of the text above ORDER bytes. A to Z count in lower case; before a text stand zero bytes.

    At most about SLICE positions come at once, however long a text is.
    """
    held, size = [], 0
    for i, text in enumerate(texts):
        data = b"\0" * (ORDER - 1) + text.encode().lower()
        for at in range(0, len(data) - ORDER + 1, SLICE):
            part = data[at : at + SLICE + ORDER - 1]
            held.append((i, part))
            size += len(part)
            if size >= SLICE:
                yield _grams(held)
                held, size = [], 0
    if held:
        yield _grams(held)


def _grams(parts: list[tuple[int, bytes]]) -> np.ndarray:
    flat = np.frombuffer(b"".join(p for _, p in parts), np.uint8).astype(np.int64)
    lengths = np.array([len(p) for _, p in parts])
    n = len(flat) - ORDER + 1
    out = np.repeat(np.array([i for i, _ in parts], np.int64), lengths)[:n]
    for j in range(ORDER):
        out = (out << 8) | flat[j : n + j]
    # what reaches into the next part is no n-gram
    valid = np.ones(n, bool)
    ends = np.cumsum(lengths)[:-1]
    for j in range(1, ORDER):
        valid[ends - j] = False
    return out[valid]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def tally(parts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for part in parts:
        part = np.sort(part)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
        new = part[first], np.diff(np.append(first, len(part)))
        keys, counts = new if not len(keys) else _summed(np.concatenate([keys, new[0]]), np.concatenate([counts, new[1]]))
    return keys, counts


COUNTS = T.StructType([T.StructField("gram", T.LongType()), T.StructField("target", T.LongType()), T.StructField("background", T.LongType())])


def _count(batches):
    """Counts of n-grams, sent on whenever a task holds KEEP of them."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def sent():
        for at in range(0, len(keys), CHUNK):
            k, n = keys[at : at + CHUNK], counts[at : at + CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array(k >> 1), pa.array(n * (k & 1)), pa.array(n)], names=COUNTS.names)

    for batch in batches:
        aimed = batch.column("aimed").to_numpy(zero_copy_only=False).astype(np.int64)
        marked = (((g & _LOW) << 1) | aimed[g >> _BITS] for g in slices(batch.column("text").to_pylist()))
        new = tally(marked)
        keys, counts = _summed(np.concatenate([keys, new[0]]), np.concatenate([counts, new[1]]))
        if len(keys) >= KEEP:
            yield from sent()
            keys, counts = keys[:0], counts[:0]
    yield from sent()


@dataclass
class Models:
    """Both models, exact: a table of histories (h, target, background, nexts: token, target, background) in the shared folder, the sums of counts, and both estimates by the byte before."""

    histories: DataFrame
    target: int
    background: int
    pairs: tuple[np.ndarray, np.ndarray]

    @property
    def scale(self) -> float:
        """What matches the models: the background's counts are weighted down to as much text as the target's, so neither is the smoother one for having more."""
        return self.target / self.background if self.background else 0.0

    def frequent(self) -> tuple[np.ndarray, ...]:
        """gram, its counts and its history's counts of the most frequent n-grams, HOT rows at most, by gram."""
        flat = self.histories.select("h", F.col("target").alias("ht"), F.col("background").alias("hb"), F.explode("nexts").alias("x"))
        # how many n-grams there are of about each count: a few hundred rows, summed up from the most frequent ones on
        level, least, held = F.floor(F.log2("x.background") * 8), float("inf"), 0
        for r in sorted(flat.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
            held += r["n"]
            if held > HOT:
                break
            least = r["level"]
        rows = flat.where(level >= least)
        table = rows.select((F.shiftleft("h", 8) + F.col("x.token")).alias("gram"), "x.target", "x.background", "ht", "hb").toArrow()
        columns = [c.to_numpy() for c in table.columns]
        order = np.argsort(columns[0])
        return tuple(c[order] for c in columns)


def fit(docs: DataFrame, text: str = "text", aimed: str = "aimed") -> Models:
    """Counts the n-grams of all texts (background) and of those marked `aimed` (target), in one pass, each for itself: nothing is hashed together or left out.

    Tasks count in parts, Spark adds these up by history, of which each has 256 next bytes at most, and the table goes to the shared folder. The driver sees two sums and one row for each
    pair of bytes.
    """
    common.small_batches(docs.sparkSession)
    narrow = docs.select(common.whole_text(text).alias("text"), F.coalesce(F.col(aimed), F.lit(False)).alias("aimed"))
    grams = narrow.mapInArrow(_count, COUNTS).groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    next_ = F.struct(F.col("gram").bitwiseAND(F.lit(255)).alias("token"), "target", "background")
    by_history = grams.groupBy(F.shiftright("gram", 8).alias("h")).agg(F.sum("target").alias("target"), F.sum("background").alias("background"), F.collect_list(next_).alias("nexts"))
    histories, _ = common.materialize(by_history, "histories")
    flat = histories.select(F.col("h").bitwiseAND(F.lit(255)).alias("before"), F.explode("nexts").alias("x"))
    sums = flat.groupBy("before", "x.token").agg(F.sum("x.target").alias("t"), F.sum("x.background").alias("b")).toArrow()  # 65536 rows at most
    counts = np.zeros((2, 256, 256))
    at = sums.column("before").to_numpy().astype(int), sums.column("token").to_numpy().astype(int)
    counts[0][at], counts[1][at] = sums.column("t").to_numpy(), sums.column("b").to_numpy()
    target, background = int(counts[0].sum()), int(counts[1].sum())
    counts[1] *= target / background if background else 0.0
    # every byte once more after every other, so that none is impossible
    pairs = tuple(((c + 1) / (c.sum(axis=1, keepdims=True) + 256)).ravel() for c in counts)
    return Models(histories, target, background, pairs)


def _difference(log, t, ht, b, hb, one_t, one_b, scale: float):
    """Loss of a token under the target model less that under the background model, in nats, from the counts of n-gram and history."""
    return log((scale * b + MASS * one_b) / (scale * hb + MASS)) - log((t + MASS * one_t) / (ht + MASS))


def by_row(docs: DataFrame, models: Models, text: str = "text", own: bool = True) -> DataFrame:
    """docs without texts, and with n_tokens, difference and worst of each row.

    own: docs are those that the models were fitted on, with the column aimed: a row's own counts are taken out of the n-gram counts before it is
    scored, so no text is known for its own sake. A row's frequent n-grams are added up where it is read; its other distinct n-grams meet their
    history in a join, and what comes of them is added up by row.
    """
    spark, scale = docs.sparkSession, models.scale
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast((models.frequent(), models.pairs))
    others = [c for c in docs.columns if c != text]
    flag = F.coalesce(F.col("aimed"), F.lit(False)) if own else F.lit(False)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*others).alias("_own"), flag.alias("_aimed"), common.whole_text(text).alias("_text"))
    fields = [("h", T.LongType()), ("token", T.LongType()), ("n", T.LongType()), ("nh", T.LongType()), ("aimed", T.BooleanType()), ("loss", T.DoubleType()), ("top", T.DoubleType())]
    kept = T.StructType([rows.schema["_row"], T.StructField("_own", rows.schema["_own"].dataType), *[T.StructField(k, t) for k, t in fields]])

    def cut(batches):
        (known, t, b, ht, hb), (one_t, one_b) = shared.value
        for batch in batches:
            ids, aim = batch.column("_row").to_numpy(), batch.column("_aimed").to_numpy(zero_copy_only=False).astype(np.int64)
            keys, n = tally(slices(batch.column("_text").to_pylist()))
            doc, gram = keys >> _BITS, keys & _LOW
            # a row's n-grams of one history stand together
            first = np.flatnonzero(np.concatenate([[True], keys[1:] >> 8 != keys[:-1] >> 8])) if len(keys) else np.empty(0, np.int64)
            nh = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(keys)))) if len(keys) else n
            at = np.searchsorted(known, gram)
            at[at == len(known)] = 0
            found = known[at] == gram if len(known) else np.zeros(len(gram), bool)
            hit, d, k = at[found], doc[found], n[found]
            less, less_h, pair = k * own, nh[found] * own, gram[found] & 0xFFFF
            loss = _difference(np.log, t[hit] - less * aim[d], ht[hit] - less_h * aim[d], b[hit] - less, hb[hit] - less_h, one_t[pair], one_b[pair], scale)
            size, total, top = np.bincount(d, k, len(ids)), np.bincount(d, k * loss, len(ids)), np.full(len(ids), -np.inf)
            np.maximum.at(top, d, loss)
            # one row for what is known already, under a history that no n-gram has, so that these are dealt evenly
            none = pa.nulls(len(ids), pa.float64())
            tops = pa.array(np.where(np.isinf(top), 0.0, top), mask=np.isinf(top))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_own"), pa.array(-1 - ids), pa.array(np.zeros(len(ids), np.int64)), pa.array(size.astype(np.int64)), pa.array(np.zeros(len(ids), np.int64)), pa.array(aim.astype(bool)), pa.array(total), tops], names=kept.names)
            doc, gram, n, nh = doc[~found], gram[~found], n[~found], nh[~found]
            empty = pa.nulls(1, batch.column("_own").type)
            for i in range(0, len(doc), CHUNK):
                s = slice(i, i + CHUNK)
                m = len(doc[s])
                none = pa.nulls(m, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[s]]), empty.take(pa.array(np.zeros(m, np.int64))), pa.array(gram[s] >> 8), pa.array(gram[s] & 255), pa.array(n[s]), pa.array(nh[s]), pa.array(aim[doc[s]].astype(bool)), none, none], names=kept.names)

    parts = rows.mapInArrow(cut, kept)
    ones = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(*models.pairs, strict=True))], "pair long, one_t double, one_b double")  # a row for each pair of bytes
    model = models.histories.select("h", F.col("target").alias("ht"), F.col("background").alias("hb"), "nexts")
    met = parts.join(model.hint("merge"), "h", "left").withColumn("x", F.get(F.filter("nexts", lambda x: x["token"] == F.col("token")), F.lit(0))).drop("nexts")
    met = met.withColumn("pair", F.col("h").bitwiseAND(F.lit(255)) * 256 + F.col("token")).join(F.broadcast(ones), "pair", "left")
    seen = lambda c: F.coalesce(F.col(c), F.lit(0))
    less, less_h = (F.col("n"), F.col("nh")) if own else (F.lit(0), F.lit(0))
    mine = F.when(F.col("aimed"), 1).otherwise(0)
    d = _difference(F.log, seen("x.target") - less * mine, seen("ht") - less_h * mine, seen("x.background") - less, seen("hb") - less_h, F.col("one_t"), F.col("one_b"), scale)
    d = F.when(F.col("loss").isNull(), d)
    sums = met.select("_row", "_own", "n", F.coalesce("loss", F.col("n") * d).alias("_sum"), F.when(F.col("loss").isNull(), d).otherwise(F.col("top")).alias("_top")).groupBy("_row").agg(F.first("_own", True).alias("_own"), F.sum("n").alias("n_tokens"), F.sum("_sum").alias("_sum"), F.max("_top").alias("_top"))
    mean = F.when(F.col("n_tokens") > 0, F.round(F.col("_sum") / F.col("n_tokens"), 9)).otherwise(0.0)
    return sums.select("_own.*", "n_tokens", mean.alias("difference"), F.round(F.coalesce("_top", F.lit(0.0)), 9).alias("worst"))


def score(docs: DataFrame, models: Models, text: str = "text", out: str = "lm", own: bool = False) -> DataFrame:
    """docs with a struct: n_tokens, difference (mean loss difference per byte; below 0: nearer to the target) and worst (the largest of one byte).

    Null and empty texts have no tokens and difference 0. Whole texts are scored; repeated rows have equal scores. A column named `out` is replaced, all others
    stay, whatever their names. docs can be others than the models were fitted on; if they are the same, own=True takes each row's own counts out (docs then has the column aimed). An empty
    table gives none; models fitted on none, or on no target, give differences of 0.
    """
    common.small_batches(docs.sparkSession)
    names = common.free_names(docs, "id")
    held, _ = common.materialize(docs.drop(out).withColumn(names["id"], F.monotonically_increasing_id()), "scored")
    narrow = held.select(F.col(names["id"]).alias("id"), F.col(text).alias("text"), *([F.col("aimed")] if own else []))
    found = by_row(narrow, models, own=own).select(F.col("id").alias(names["id"]), F.struct("n_tokens", "difference", "worst").alias(out))
    return held.join(found.hint("merge"), names["id"]).drop(names["id"])


def aim(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with a column aimed: true for documents that labels mark as of good quality and not toxic. Texts move only if these are too many to be broadcast."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(key).where(F.col(key).isNotNull()).distinct().withColumn("aimed", F.lit(True))
    return docs.drop("aimed").join(common.sized(good), key, "left")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = aim(common.read(spark, sf_dir, "documents").select("doc_id", "text"), common.read(spark, sf_dir, "labels"))
    return by_row(docs, fit(docs)).select("doc_id", "n_tokens", F.col("difference").alias("score"), F.col("worst").alias("worst_token"))
