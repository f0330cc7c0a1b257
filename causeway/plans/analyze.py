"""Analysis of free texts: sentences, the pair of each, events shared by phrase, relations with probabilities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import workers
from ..functions import text as X
from ..sources.store import settled, spread
from . import steps


#: Texts of one line and so many characters at most are searched where they stand; in longer ones all phrases of a document are looked for together.
SHORT = 1000
_MULTIPLIER = 0x9E3779B97F4A7C15


def first_places(text: str, phrases: list[str]) -> list[int]:
    """Where each phrase first stands in the text, -1 if nowhere. The work grows with the text times the number of different lengths, not of phrases.

    For each length one hash per place is compared with those of all phrases of that length; the first place of an equal hash is checked, and searched for plainly if it was a collision.
    """
    n = len(text)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    powers, inverse = (np.full(n + 1, m, np.uint64) for m in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)))
    for x in (powers, inverse):
        x[0] = 1
        np.cumprod(x, out=x)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * powers[:n], dtype=np.uint64)])
    of_length: dict[int, dict[int, str]] = {}
    places = dict.fromkeys(phrases, -1)
    for p in places:
        value = 0
        for c in reversed(p):
            value = (value * _MULTIPLIER + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        if value in of_length.setdefault(len(p), {}):
            places[p] = text.find(p)
        else:
            of_length[len(p)][value] = p
    for size, wanted in of_length.items():
        if not 0 < size <= n:
            places |= {p: text.find(p) for p in wanted.values()}
            continue
        seen = np.zeros(1 << 16, bool)
        seen[np.fromiter(wanted, np.uint64, len(wanted)) >> np.uint64(48)] = True
        hashes = (sums[size:] - sums[: n - size + 1]) * inverse[: n - size + 1]
        at = np.flatnonzero(seen[hashes >> np.uint64(48)])
        for h, i in zip(*(x.tolist() for x in np.unique(hashes[at], return_index=True)), strict=True):
            if h in wanted:
                p, first = wanted[h], int(at[i])
                places[p] = first if text.startswith(p, first) else text.find(p)
    return [places[p] for p in phrases]


_FOUND = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("said", T.StringType())]))


def _search():
    """Of a document's asked phrases (name, phrase): their first place in the lower-case text, 0 if there is none, and what the text has there."""

    @F.arrow_udf(_FOUND)
    def run(texts: pa.Array, lower: pa.Array, asked: pa.Array) -> pa.Array:
        out = []
        for text, low, some in zip(texts.to_pylist(), lower.to_pylist(), asked.to_pylist(), strict=True):
            at = [max(i, 0) for i in first_places(low, [x["name"] for x in some])]
            out.append([{"name": x["name"], "phrase": x["phrase"], "at": i, "said": text[i : i + len(x["phrase"])]} for x, i in zip(some, at, strict=True)])
        return pa.array(out, _ARROW)

    return run


_ARROW = pa.list_(pa.struct([("name", pa.string()), ("phrase", pa.string()), ("at", pa.int32()), ("said", pa.string())]))


def _described(first: DataFrame, own: DataFrame, canonizer) -> DataFrame:
    """(_key, name, description) of the events first (_key, _doc, name, phrase) in the documents own (_key, _doc, _text)."""
    spark = own.sparkSession
    workers.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    asked = first.groupBy("_key", "_doc").agg(F.collect_list(F.struct("name", "phrase")).alias("asked")).withColumnsRenamed({"_key": "_k", "_doc": "_d"})
    both = own.join(asked, (F.col("_doc") == F.col("_d")) & F.col("_key").eqNullSafe(F.col("_k")))
    found = both.select("_key", "_text", F.explode_outer(_search()("_text", F.lower("_text"), "asked")).alias("f"))
    said = F.col("f.said") if canonizer is steps.passthrough else canonizer(F.col("_text"), F.col("f.at"), F.col("f.at") + F.length("f.phrase"))
    return found.select("_key", F.col("f.name").alias("name"), said.alias("description"))


def analyze(docs: DataFrame, key: str = "doc_id", text: str = "text", canonizer=steps.passthrough) -> tuple[DataFrame, DataFrame]:
    """(events, relations) of every document. events: key, index, span_text, description, start, end; relations: indices of both ends, texts, canonical forms, type, probabilities.

    An event is a phrase, letter case aside: where it comes again, its first place and description stand for it. Indices count from 0 in order of appearance, causes first.
    A phrase that isn't in its sentence makes no relation. Blank documents have neither. Keys are those of documents: one that repeats with another text adds to the same events.
    Sentences never go beyond a line, so lines are dealt to tasks and a long document is no single one's work; what was found is written once, and read for both results.
    """
    own = docs.where(F.col(text).rlike(r"(?U)\S")).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_doc"))
    short = ~F.col("_text").contains("\n") & (F.length("_text") <= SHORT)
    # each line with its end
    lines = own.select("_key", "_doc", short.alias("_short"), F.posexplode(F.split("_text", "(?<=\n)", -1)).alias("_row", "_l"))
    lines = spread(lines, "_key", "_doc", "_row")
    cut = lines.select("*", F.posexplode_outer(X.sentences(F.col("_l"))).alias("_j", "_s"))
    # a pair is made by a generator, so that no filter computes it again
    tried = cut.select("*", F.explode_outer(F.array(steps.pair(F.col("_s.sentence")))).alias("p"))
    side = lambda r, i: F.struct(F.lit(i).alias("order"), F.col(f"p.{r}").alias("phrase"), X.find(F.col("_s.sentence"), F.col(f"p.{r}")).alias("at"), F.when(F.col("_short"), X.span_or_start(F.col("_l"), F.col(f"p.{r}"))).alias("whole"))
    ends = F.when(F.col("p.kind").isNotNull(), F.array(side("cause", 0), side("effect", 1)))
    met = tried.select("_key", "_doc", "_short", "_row", F.coalesce("_j", F.lit(0)).alias("_j"), F.length("_l").alias("_n"), F.col("_s").isNotNull().cast("int").alias("_one"), F.col("_s.start").alias("start"), "p", ends.alias("ends"), F.when(F.col("_short"), F.col("_l")).alias("_l"))
    so_far = Window.partitionBy("_key", "_doc").orderBy("_row", "_j").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(F.when(F.col("_j") == 0, F.col("_n")).otherwise(0)).over(so_far) - F.col("_n")
    placed = met.withColumn("_line", (F.sum("_one").over(so_far) - 1).cast("int")).withColumn("offset", (before + F.col("start")).cast("int"))
    both = settled(placed.where("ends[0].at is not null and ends[1].at is not null").select("_key", "_doc", "_short", "_line", "offset", "p", "ends", "_l"), "pairs")
    spans = both.select("_key", "_doc", "_short", "_line", "offset", "_l", F.explode("ends").alias("x"))
    here = F.when(F.col("_short"), canonizer(F.col("_l"), F.col("x.whole.start"), F.col("x.whole.end")))
    rows = spans.select("_key", "_doc", "_short", "_line", F.col("x.order").alias("order"), F.col("x.phrase").alias("phrase"), F.lower("x.phrase").alias("name"), (F.col("offset") + F.col("x.at.start")).alias("start"), (F.col("offset") + F.col("x.at.end")).alias("end"), here.alias("description"))
    place = F.struct("_line", "order")
    first = rows.groupBy("_key", "name").agg(F.min(place).alias("place"), F.min_by(F.struct("_doc", "_short", "phrase", "description", "start", "end"), place).alias("v"))
    index = (F.row_number().over(Window.partitionBy("_key").orderBy("place")) - 1).alias("index")
    events = settled(first.select("_key", "name", index, "v.*"), "events")
    far = events.where(~F.col("_short"))
    if not far.isEmpty():
        told = _described(far, own.where(~short), canonizer).withColumnsRenamed({"_key": "_k", "name": "_name", "description": "_said"})
        events = settled(events.join(told, (F.col("name") == F.col("_name")) & F.col("_key").eqNullSafe(F.col("_k")), "left").withColumn("description", F.coalesce("_said", "description")).drop("_k", "_name", "_said"), "events")
    ids = events.select("_key", "name", "index", "description")
    relations = both.select("_key", "_line", F.col("p.cause").alias("cause_text"), F.col("p.effect").alias("effect_text"), F.col("p.kind").alias("kind"))
    for r in ("cause", "effect"):
        relations = relations.withColumn("name", F.lower(f"{r}_text")).join(ids.withColumnsRenamed({"index": f"{r}_event_index", "description": f"{r}_canonical"}), ["_key", "name"]).drop("name")
    typed = relations.select(F.col("_key").alias(key), F.col("_line").alias("sentence_index"), "cause_event_index", "effect_event_index", "cause_text", "effect_text", "cause_canonical", "effect_canonical", F.when(F.col("kind") == "negation", "countercausal").otherwise("causal").alias("relation_type"), X.label_probabilities(F.col("kind")).alias("p")).select("*", "p.*").drop("p")
    return events.select(F.col("_key").alias(key), "index", F.col("phrase").alias("span_text"), "description", "start", "end"), typed


def response(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, json): the analysis of each document as one JSON object."""
    events, relations = analyze(docs, key, text)
    e = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("index", "span_text", "description", "start", "end"))).alias("events"))
    r = relations.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("sentence_index", *[c for c in relations.columns if c not in (key, "sentence_index")]))).alias("relations"))
    joined = docs.select(key, text).join(e, key, "left").join(r, key, "left")
    return joined.select(key, F.to_json(F.struct(F.col(text).alias("text"), F.coalesce("events", F.array().cast(e.schema["events"].dataType)).alias("events"), F.coalesce("relations", F.array().cast(r.schema["relations"].dataType)).alias("relations"))).alias("json"))
