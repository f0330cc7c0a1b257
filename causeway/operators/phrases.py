"""Phrases around spans, over supplied tables of phrases and tokens: which phrase covers a span, and how far the tokens below a token reach.

Each has two forms. Over tables, long documents are dealt to many tasks, and what belongs together meets by shuffles. The forms named _in take a row for each document, with arrays: nothing of
them is shuffled or written, but all that a row has is looked at together, so they are for short texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import workers
from . import doubling

#: Characters in a bin of positions.
BIN = 256


def _binned(df: DataFrame) -> DataFrame:
    """A row for each bin that a piece (doc, start, end) stands in."""
    return df.withColumn("_bin", F.explode(F.sequence(F.expr(f"start div {BIN}"), F.expr(f"greatest(start, end - 1) div {BIN}"))))


def enclosing(spans: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc, start, end, p_start, p_end, covers): spans (doc, start, end) with the phrases (doc, start, end) that cover them, or that only share their end and start inside them.

    Positions are 0-based, ends exclusive. What covers a span stands in the bin of its start, and what shares its end is found by the end: both are equi joins by document and place, so
    a long document is dealt to as many tasks as it has bins. Equal spans and equal phrases count once; empty ones cover nothing and are covered like others.
    """
    s, p = spans.select("doc", "start", "end").distinct(), phrases.select("doc", F.col("start").alias("p_start"), F.col("end").alias("p_end")).distinct()
    bins = _binned(p.select("doc", F.col("p_start").alias("start"), F.col("p_end").alias("end"))).select("doc", "_bin", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    around = s.withColumn("_bin", F.expr(f"start div {BIN}")).join(bins, ["doc", "_bin"]).where((F.col("p_start") <= F.col("start")) & (F.col("end") <= F.col("p_end")))
    inside = s.join(p.withColumn("end", F.col("p_end")), ["doc", "end"]).where(F.col("p_start") > F.col("start"))
    columns = ("doc", "start", "end", "p_start", "p_end")
    return around.select(*columns, F.lit(True).alias("covers")).unionByName(inside.select(*columns, F.lit(False).alias("covers")))


def enclosing_in(rows: DataFrame) -> DataFrame:
    """enclosing() of rows (doc, spans, phrases), one for each document: arrays of (start, end)."""
    # generators, so that arrays are made once
    once = rows.where("doc is not null").select("doc", F.explode(F.array(F.struct(F.array_distinct("spans").alias("s"), F.array_distinct("phrases").alias("p")))).alias("a"))
    pairs = once.select("doc", F.explode("a.s").alias("s"), F.col("a.p").alias("ps")).select("doc", "s.start", "s.end", F.explode("ps").alias("p"))
    pairs = pairs.select("doc", "start", "end", F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"))
    covers = (F.col("p_start") <= F.col("start")) & (F.col("end") <= F.col("p_end"))
    inside = (F.col("p_end") == F.col("end")) & (F.col("p_start") > F.col("start"))
    return pairs.where(covers | inside).withColumn("covers", F.col("p_start") <= F.col("start"))


def smallest_phrase(spans: DataFrame, phrases: DataFrame, tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, start, end, p_start, p_end) for the spans that a phrase stands for.

    That is the shortest that covers the span, the first of equal ones. If none does, the first phrase that shares its end counts, so that an introducing word falls away, provided that
    a token in it depends on exactly what stands before it in the span. texts: (doc, text).
    """
    found = enclosing(spans, phrases)
    span = ["doc", "start", "end"]
    best = found.where("covers").groupBy(*span).agg(F.min(F.struct((F.col("p_end") - F.col("p_start")).alias("n"), "p_start", "p_end")).alias("p")).select(*span, "p.p_start", "p.p_end")
    part = found.where("not covers").groupBy(*span).agg(F.min(F.struct("p_start", "p_end")).alias("p")).select(*span, "p.p_start", "p.p_end").join(best.select(*span), span, "left_anti")
    before = part.join(texts.select("doc", "text"), "doc").select(*span, "p_start", "p_end", F.rtrim(F.substring("text", F.col("start") + 1, F.col("p_start") - F.col("start"))).alias("before"))
    at = before.withColumn("_bin", F.explode(F.sequence(F.expr(f"p_start div {BIN}"), F.expr(f"(p_end - 1) div {BIN}"))))
    # only of tokens in such phrases is the head looked up
    words = tokens.select("doc", F.expr(f"start div {BIN}").alias("_bin"), F.col("start").alias("t_start"), "head")
    inside = at.join(words, ["doc", "_bin"]).where((F.col("t_start") >= F.col("p_start")) & (F.col("t_start") < F.col("p_end"))).select(*span, "p_start", "p_end", "before", "head").distinct()
    hung = inside.join(tokens.select("doc", F.col("i").alias("head"), F.col("text").alias("before")), ["doc", "head", "before"])
    return best.unionByName(hung.select(*span, "p_start", "p_end").distinct())


def smallest_phrase_in(rows: DataFrame) -> DataFrame:
    """smallest_phrase() of rows (doc, text, tokens, phrases, spans), one for each document: arrays of (start, end), of tokens (start, text, head) by their place."""
    once = rows.where("doc is not null").select("doc", F.explode(F.array(F.struct("text", "tokens", F.array_distinct("spans").alias("s"), F.array_distinct("phrases").alias("p")))).alias("a"))
    each = once.select("doc", F.col("a.text").alias("text"), F.col("a.tokens").alias("tokens"), F.col("a.p").alias("ps"), F.explode("a.s").alias("s")).select("doc", "s.start", "s.end", "text", "tokens", "ps")
    around = F.filter("ps", lambda p: (p["start"] <= F.col("start")) & (F.col("end") <= p["end"]))
    best = F.array_min(F.transform(around, lambda p: F.struct((p["end"] - p["start"]).alias("n"), p["start"].alias("start"), p["end"].alias("end"))))
    part = F.array_min(F.filter("ps", lambda p: (p["end"] == F.col("end")) & (p["start"] > F.col("start"))))
    found = each.select("doc", "start", "end", "text", "tokens", F.explode(F.array(F.struct(best.alias("best"), part.alias("part")))).alias("f"))
    before = F.rtrim(F.substring("text", F.col("start") + 1, F.col("f.part.start") - F.col("start")))
    hung = F.exists("tokens", lambda t: (t["start"] >= F.col("f.part.start")) & (t["start"] < F.col("f.part.end")) & (F.get("tokens", t["head"])["text"] == before))
    kept = found.where(F.col("f.best").isNotNull() | (F.col("f.part").isNotNull() & hung))
    return kept.select("doc", "start", "end", F.coalesce("f.best.start", "f.part.start").alias("p_start"), F.coalesce("f.best.end", "f.part.end").alias("p_end"))


def reach(tokens: DataFrame) -> DataFrame:
    """(doc, i, last): the greatest index among a token and all that depend on it, directly or not. tokens: (doc, i, head); a root's head is itself or null.

    The trees of all documents are walked together, in as many rounds as the deepest has binary digits of depth.
    """
    node = lambda c: F.when(F.col(c).isNotNull(), F.struct("doc", F.col(c).alias("i")))
    rows = tokens.select(F.struct("doc", "i").alias("node"), node("head").alias("up"), F.col("i").alias("last"))
    return doubling.accumulated(doubling.forest(rows, "node", "up", "last"), "last", "max").select("node.doc", "node.i", "last")


def _reached(heads: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, last) of the tokens of all rows: reach() of each row's heads. Steps up double, for all rows together; the greatest index may count twice, so cycles need no care."""
    sizes = np.diff(heads.offsets.to_numpy())
    row, begin = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
    i, here = np.arange(len(row)) - begin, np.arange(len(row))
    head = heads.flatten().fill_null(-1).to_numpy()
    up, last = np.where((head >= 0) & (head < sizes[row]), head + begin, here), i.copy()
    step, longest = 1, int(sizes.max(initial=0))
    while step < longest:
        new = last.copy()
        np.maximum.at(new, up, last)
        last, further, step = new, up[up], step * 2
        if (further == up).all():  # everything has met its root, a step of its own away at most
            np.maximum.at(last, up, last.copy())
            break
        up = further
    return row, i, last


def reach_in(rows: DataFrame) -> DataFrame:
    """reach() of rows (doc, heads), one for each document: the head of each token by its place i."""
    workers.ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, i, last = _reached(b.column("heads"))
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(row)), pa.array(i, pa.int32()), pa.array(last, pa.int32())], names=["doc", "i", "last"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.select("doc", F.col("heads").cast("array<int>").alias("heads")).where("size(heads) > 0").mapInArrow(run, f"doc {kind}, i int, last int")
