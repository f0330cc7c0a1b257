"""Substring dedup: passages of many words that stand earlier in the corpus are taken out, found by suffix automata over shards of reference passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words of a window, words of the gram that stands for it, and bytes of text that are split at once.
WINDOW, GRAM, CHUNK = 20, 8, 1 << 20
#: Windows that are looked at in one step, words whose hashes a worker remembers.
STEP, WORDS = 1 << 16, 1 << 19
#: Passages in a shard; anchors with more different passages than CROWD go by windows.
SHARD, CROWD = 2000, 512
#: Numbers that give other orders of grams, for the anchors of crowded passages.
ORDERS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: The key that rows without one count as: before all others.
NO_KEY = -(1 << 63)
_ODD, _EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """64-bit hashes of words, the first WORDS of them remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 11)
        if len(self) < WORDS:
            self[word] = h
        return h


def _pieces(data: bytes) -> Iterator[bytes]:
    """data in pieces of about CHUNK bytes, cut between words."""
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end


def word_hashes(text: str | None, memo: dict) -> np.ndarray:
    """One hash for each word of a text; words are runs of other than ASCII white space."""
    parts = [np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)) for words in (p.split() for p in _pieces((text or "").encode())) if words]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _EVEN
    return x ^ (x >> np.uint64(32))


def anchors(h: np.ndarray, window: int = WINDOW, order: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """(at, hash, passage) of the anchors of a text of these word hashes, some windows at a time.

    Every window of `window` words has one anchor: the gram in it of least hash, the first of equal ones. So equal windows have equal anchors at equal places. The windows
    of one anchor follow each other; the words from the first's start to the last's end are its passage. `at` holds the anchor's place and, in four bits
    each, how far before it the first and the last of its windows start. Another `order` of the grams gives other anchors.
    """
    reach = window - GRAM + 1
    for at in range(0, len(h) - window + 1, STEP):
        part = h[at : at + STEP + window - 1]
        grams = part[: len(part) - GRAM + 1].copy()
        for k in range(1, GRAM):
            grams = grams * _ODD + part[k : len(part) - GRAM + 1 + k]
        grams = _mixed(grams ^ np.uint64(order))
        places = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(axis=1)
        places += np.arange(len(places))
        first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
        last = np.concatenate((first[1:], [len(places)])) - 1
        place, length, passage = places[first], last - first + window, np.zeros(len(first), np.uint64)
        padded = np.concatenate((part, np.zeros(reach, np.uint64)))
        for k in range(window + reach - 1):
            passage = np.where(k < length, passage * _EVEN + padded[np.minimum(first + k, len(padded) - 1)], passage)
        yield ((place + at) << 8) | ((place - first) << 4) | (place - last), grams[place], _mixed(passage ^ length.astype(np.uint64))


_ANCHORS = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "tie", "at", "a", "c")])


def _find_anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            for key, tie, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                for at, a, c in anchors(word_hashes(text.as_py(), memo), window):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key.as_py())), pa.array(np.full(n, tie.as_py())), pa.array(at), pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=_ANCHORS.names)

    return run


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_PASSAGES = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "tie", "start", "a", "m")] + [T.StructField("words", T.ArrayType(T.LongType()))])


def _cut_passages(window: int):
    """Rows (id, tie, text, marks) to one row for each of the marks, with the hashes of its passage's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            for row in batch.to_pylist():
                h, out = word_hashes(row["text"], memo).view(np.int64), []
                for m in row["marks"]:
                    place = m["at"] >> 8
                    start, end = place - (m["at"] >> 4 & 15), place - (m["at"] & 15) + window
                    out.append((row["id"], row["tie"], start, m["a"], m["m"], h[start:end]))
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=_PASSAGES.names)

    return run


class Automaton:
    """A suffix automaton of several sequences: it knows every run of symbols in them, and where it first ended in order of adding."""

    def __init__(self) -> None:
        self.to: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, to: dict, length: int, link: int, first) -> int:
        self.to.append(to)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.to) - 1

    def add(self, symbols, ends) -> None:
        """Adds a sequence; ends[i] is the place of symbols[i], and places ascend from call to call."""
        last, to, link, length = 0, self.to, self.link, self.length
        for s, end in zip(symbols, ends, strict=True):
            known = to[last].get(s)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._split(last, known, s)
                continue
            new = self._state({}, length[last] + 1, 0, end)
            p = last
            while p >= 0 and s not in to[p]:
                to[p][s] = new
                p = link[p]
            if p >= 0:
                q = to[p][s]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, s)
            last = new

    def _split(self, p: int, q: int, s) -> int:
        """A state for the runs of q that are no longer than those of p and s; they first ended where those of q did."""
        to, link = self.to, self.link
        half = self._state(dict(to[q]), self.length[p] + 1, link[q], self.first[q])
        link[q] = half
        while p >= 0 and to[p].get(s) == q:
            to[p][s] = half
            p = link[p]
        return half

    def matches(self, symbols, least: int) -> Iterator[tuple[int, object]]:
        """(i, first) for every i at which a run of `least` symbols that the automaton knows ends, and where that run first ended."""
        v = n = 0
        for i, s in enumerate(symbols):
            while v and s not in self.to[v]:
                v = self.link[v]
                n = self.length[v]
            if s in self.to[v]:
                v = self.to[v][s]
                n += 1
            while self.length[max(self.link[v], 0)] >= least:
                v = self.link[v]
                n = self.length[v]
            if n >= least:
                yield i, self.first[v]


_SPANS = "id bigint, tie bigint, start bigint, end bigint"


def _match_shard(window: int):
    """Spans of a shard's passages that stand earlier in it: all passages in order make one automaton, then each is streamed through it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "tie", "start"])
        known, out = Automaton(), []
        every = list(zip(rows["id"], rows["tie"], rows["start"], rows["words"], strict=True))
        for key, tie, start, words in every:
            known.add(words.tolist(), [(key, tie, start + i) for i in range(len(words))])
        for key, tie, start, words in every:
            for i, first in known.matches(words.tolist(), window):
                if first < (key, tie, start + i):
                    end = start + i + 1
                    if out and out[-1][:2] == (key, tie) and out[-1][3] == end - 1:
                        out[-1] = (key, tie, out[-1][2], end)
                    else:
                        out.append((key, tie, end - window, end))
        return pd.DataFrame(out, columns=["id", "tie", "start", "end"])

    return run


def _keyed(df: DataFrame, text: str, key: str) -> DataFrame:
    """(id, tie, text): id is the key, NO_KEY where it is null; tie tells the texts of one id apart and is 0 for ids of one row."""
    docs = df.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("id"), common.whole_text(text).alias("text"))
    again, path = common.materialize(docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("again")), "again")
    if again.isEmpty():
        common.discard(df.sparkSession, path)
        return docs.select("id", F.lit(0).cast("bigint").alias("tie"), "text")
    return docs.join(common.sized(again), "id", "left").select("id", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0)).cast("bigint").alias("tie"), "text")


_PARTS = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "tie", "start", "a", "c")] + [T.StructField("words", T.ArrayType(T.LongType()))])


def _part_passages(window: int, order: int):
    """Passages (id, tie, start, a, words) to the passages of their windows' anchors in another order of grams; a goes into the new anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                h = np.array(row["words"], np.int64)
                for at, a, c in anchors(h.view(np.uint64), window, order):
                    place = at >> 8
                    first, last = (place - (at >> 4 & 15)).tolist(), (place - (at & 15) + window).tolist()
                    both = _mixed(a ^ np.uint64(row["a"] & (1 << 64) - 1) * _ODD).view(np.int64).tolist()
                    out += [(row["id"], row["tie"], row["start"] + i, x, y, h[i:j]) for i, j, x, y in zip(first, last, both, c.view(np.int64).tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in columns[:5]] + [pa.array(list(columns[5]), pa.list_(pa.int64()))], names=_PARTS.names)

    return run


def _parted(passages: DataFrame, window: int, order: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(spans, passages, tables): crowded passages divided by second anchors of their windows. Equal parts are repeated but for the first; parts with an anchor of their own are done."""
    rows, path = common.materialize(passages.select("id", "tie", "start", "a", "words").mapInArrow(_part_passages(window, order), _PARTS), "parts")
    kinds, k_path = common.materialize(rows.groupBy(F.struct("a", "c").alias("k")).agg(F.min(F.struct("id", "tie", "start")).alias("f"), F.count("*").alias("n")), "passages")
    met, m_path = common.materialize(common.spread_join(rows.withColumn("k", F.struct("a", "c")), kinds, "k", common.HUB).withColumn("first", F.struct("id", "tie", "start") == F.col("f")).select("id", "tie", "start", "a", "words", "first"), "parts")
    several = kinds.groupBy(F.col("k.a").alias("a")).agg(F.count("*").alias("m")).where("m > 1")
    rest, r_path = common.materialize(met.where("first").join(several, "a").select("id", "tie", "start", "a", "m", "words"), "references")
    common.discard(rows.sparkSession, path, k_path)
    return met.where("not first").select("id", "tie", "start", (F.col("start") + F.size("words")).alias("end")), rest, [m_path, r_path]


def _window_spans(passages: DataFrame, window: int) -> DataFrame:
    """Spans of windows that stand earlier, by hashes of 128 bits of the windows themselves: for anchors of so many passages that no shard could hold them."""
    at = passages.select("id", "tie", "start", "words", F.explode(F.sequence(F.lit(0), F.size("words") - window)).alias("i"))
    run = F.slice("words", F.col("i") + 1, window)
    flat = at.select("id", "tie", (F.col("start") + F.col("i")).alias("start"), F.struct(F.xxhash64(run).alias("x"), F.xxhash64(F.lit(window), run).alias("y")).alias("w"))
    first = flat.groupBy("w").agg(F.min(F.struct("id", "tie", "start")).alias("f"), F.count("*").alias("n")).where("n > 1")
    met = common.spread_join(flat, first, "w", common.HUB)
    return met.where(F.struct("id", "tie", "start") != F.col("f")).select("id", "tie", "start", (F.col("start") + window).alias("end"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> tuple[DataFrame, list[str]]:
    """(id, tie, start, end): spans of words covered by windows that stand earlier in docs (id, tie, text); and the tables it reads.

    1. Anchors (anchors()): about one for seven words, so what is shuffled is a part of the text. Anchors that occur once are in no repeated window.
    2. Of the places that have one anchor and one passage, the first stays and all others are repeated as a whole: copies are done with here, never paired.
    3. What is left are anchors with several different passages: the ends of repeated ones, and places of edits. The first place of each such passage is a reference.
       References are dealt to shards by their anchor, so all that can match is in one shard, of bounded size. A shard's suffix automaton is made where the shard
       is; the references are streamed through it for matching statistics, and what first ended elsewhere is repeated.
    Anchors with more than `crowd` passages (one very common passage between ever new words) would make one shard too large. Their passages are divided by second and third anchors, in
    other orders of grams, and what is crowded still meets by hashes of its windows. All ways are exact.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    find = _find_anchors(window)
    every, e_path = common.materialize(docs.mapInArrow(lambda b: _gathered(find(b)), _ANCHORS), "anchors")
    live, l_path = common.materialize(every.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"), "live")
    rows = int(live.agg(F.sum("n")).first()[0] or 0)
    most = common.hub_bound(rows)
    some, s_path = common.materialize(common.spread_join(every, live, "a", most).select("id", "tie", "at", F.struct("a", "c").alias("k")), "places")
    common.discard(spark, e_path, l_path)
    kinds, k_path = common.materialize(some.groupBy("k").agg(F.min(F.struct("id", "tie", "at")).alias("f"), F.count("*").alias("n")), "passages")
    repeated = common.spread_join(some, kinds.where("n > 1"), "k", most).where(F.struct("id", "tie", "at") != F.col("f"))
    place = F.shiftright("at", 8)
    whole = repeated.select("id", "tie", (place - (F.shiftright("at", 4).bitwiseAND(F.lit(15)))).alias("start"), (place - F.col("at").bitwiseAND(F.lit(15)) + window).alias("end"))
    whole, w_path = common.materialize(whole, "whole")
    several = kinds.groupBy("k.a").agg(F.count("*").alias("m")).where("m > 1")
    marks = kinds.select("k.a", "f").join(several, "a").select("f.id", "f.tie", F.struct("f.at", "a", "m").alias("mark")).groupBy("id", "tie").agg(F.collect_list("mark").alias("marks"))
    marks, m_path = common.materialize(marks, "marks")
    common.discard(spark, s_path, k_path)
    texts = docs.join(common.sized(marks.select("id").distinct()), "id", "left_semi")
    passages, p_path = common.materialize(texts.join(marks.hint("merge"), ["id", "tie"]).mapInArrow(_cut_passages(window), _PASSAGES), "references")
    common.discard(spark, m_path)
    spans, paths = whole, [w_path]
    for order in (*ORDERS, None):
        shards = max(1, passages.count() // SHARD)
        dealt = passages.where(F.col("m") <= crowd).withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)))
        matched, d_path = common.materialize(dealt.drop("a", "m").groupBy("shard").applyInPandas(_match_shard(window), _SPANS), "matched")
        spans, crowded = spans.unionByName(matched), passages.where(F.col("m") > crowd)
        paths += [d_path, p_path]
        if crowded.isEmpty():
            break
        if order is None:
            rest, r_path = common.materialize(_window_spans(crowded, window), "windows")
            spans, paths = spans.unionByName(rest), [*paths, r_path]
        else:
            more, passages, (m_path, p_path) = _parted(crowded, window, order)
            spans, paths = spans.unionByName(more), [*paths, m_path]
    return spans, paths


_KEPT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Number of words, number of those in spans, and the others joined by one space."""
    words, kept, at = text.encode().split(), [], 0
    for start, end in sorted(spans):
        kept += words[at : max(start, at)]
        at = max(at, end)
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept).decode()


@F.arrow_udf(_KEPT)
def _cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    rows = [cut(t or "", list(zip(s or [], e or [], strict=True))) for t, s, e in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=_KEPT.names)


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """One row per row of df: key, n_words, n_removed and kept, the words that stay joined by one space.

    Words are runs of other than ASCII white space, unchanged. A word goes if it is in a window of `window` consecutive words whose sequence starts earlier too: in a row of
    smaller key, or before in the same text. All windows are judged on the input. Null and empty texts, and texts of fewer words than a window, stay as they are (null: no words).
    Keys are integers; rows without one come before all others. Rows that repeat key and text are one document, of which each row gets the result; different texts of one
    key are ordered by their hash. An empty table gives no rows. Columns other than key and text aren't looked at.
    """
    spark = df.sparkSession
    if not GRAM <= window < GRAM + 16:
        raise ValueError(f"windows have {GRAM} to {GRAM + 15} words")
    docs = _keyed(df, text, key)
    spans, paths = repeated_spans(docs, window, crowd)
    by_text, path = common.materialize(spans.groupBy("id", "tie").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "spans")
    common.discard(spark, *paths)
    ids = common.sized(by_text.select("id").distinct())
    touched = docs.join(ids, "id", "left_semi").join(by_text.hint("merge"), ["id", "tie"], "left")
    none = F.lit(None).cast("array<bigint>")
    rest = docs.join(ids, "id", "left_anti").select("id", "tie", "text", none.alias("starts"), none.alias("ends"))
    out = touched.select(rest.columns).unionByName(rest).select("id", _cut("text", "starts", "ends").alias("r"))
    own = F.when(F.col("id") != NO_KEY, F.col("id")).cast(df.schema[key].dataType)
    return out.select(own.alias(key), "r.n_words", "r.n_removed", "r.kept")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""WITH texts AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
  windows AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') s FROM (SELECT doc_id, ws, unnest(range(1, len(ws)-18)) i FROM texts)),
  again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) r FROM windows) WHERE r>1),
  gone AS (SELECT DISTINCT doc_id, i+j j FROM again, (SELECT unnest(range(0, 20)) j)),
  words AS (SELECT doc_id, unnest(ws) w, generate_subscripts(ws, 1) j FROM texts),
  kept AS (SELECT doc_id, count(*) n, string_agg(w, ' ' ORDER BY j) t FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
  SELECT t.doc_id, len(ws) n_words, len(ws)-coalesce(n, 0) n_removed, sha256(coalesce(k.t, '')) kept_sha256 FROM texts t LEFT JOIN kept k ON k.doc_id=t.doc_id"""
