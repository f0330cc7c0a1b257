"""Spelling variants: words at one inserted, deleted or replaced letter, found in forward and backward minimal acyclic automata, and grouped under their commonest form."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Letters of a word at least, how often it occurs at least, one in how many runs loses a letter, and how many times commoner a form is than its variant.
LEAST, SEEN, ONE_IN, TIMES = 7, 2, 31, 10
#: Different words that a worker counts before it passes them on; characters of text that are searched at once.
HELD, CHUNK = 1 << 17, 1 << 20
#: Rows of a shard; words under one key of a direction in one cell.
SHARD, CELL = 20_000, 5_000
_RUN = re.compile("[a-z\u00c0-\u00ff]{%d,}" % LEAST)
_GAP = re.compile("[^A-Za-z\u00c0-\u00ff]")


def runs_of(text: str) -> Counter:
    """The maximal runs of letters A to Z, a to z and U+00C0 to U+00FF that have LEAST or more, A to Z in lower case, with their numbers."""
    out, at = Counter(), 0
    while at < len(text):
        gap = _GAP.search(text, at + CHUNK)
        end = gap.start() if gap else len(text)
        out.update(_RUN.findall(text[at:end].encode().lower().decode()))
        at = end
    return out


def words_of(key: int | None, text: str) -> Iterator[tuple[str, int]]:
    """Words of a text with their numbers: its runs, of which one in ONE_IN, by a checksum of key and run, loses the letter that the checksum names."""
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    for run, n in runs_of(text).items():
        h = zlib.crc32(run.encode(), start)
        if h % ONE_IN:
            yield run, n
        elif len(run) > LEAST:
            at = h % len(run)
            yield run[:at] + run[at + 1 :], n


_COUNTS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=_COUNTS.names)

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            for word, n in words_of(key.as_py(), text.as_py() or ""):
                held[word] += n
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def counts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): words of SEEN or more occurrences in all texts. Workers add up what they see before anything is shuffled."""
    common.small_batches(df.sparkSession)
    found = df.select(F.col(key).alias("key"), common.whole_text(text).alias("text")).mapInArrow(_counted, _COUNTS)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)


class Words:
    """The minimal acyclic automaton of words, which are distinct and sorted. Every edge holds how many words come before those behind it, so a path's sum is the word's number."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        nodes, before = [[False, {}]], ""
        for word in words:
            same = len(os.path.commonprefix((before, word)))
            self._close(nodes, before, same, known)
            nodes += [[False, {}] for _ in word[same:]]
            nodes[-1][0] = True
            before = word
        self._close(nodes, before, 0, known)
        self.root = self._state(nodes[0], known)

    def _close(self, nodes: list, word: str, keep: int, known: dict) -> None:
        while len(nodes) - 1 > keep:
            state = self._state(nodes.pop(), known)
            nodes[-1][1][word[len(nodes) - 1]] = state

    def _state(self, node: list, known: dict) -> int:
        key = (node[0], *node[1].items())
        state = known.get(key)
        if state is None:
            n, edges = int(node[0]), {}
            for c, to in node[1].items():
                edges[c] = (to, n)
                n += self.size[to]
            state = known[key] = len(self.edges)
            self.edges.append(edges)
            self.final.append(node[0])
            self.size.append(n)
        return state

    def _walk(self, state: int, number: int, letters: str) -> tuple[int, int] | None:
        for c in letters:
            edge = self.edges[state].get(c)
            if edge is None:
                return None
            state, number = edge[0], number + edge[1]
        return state, number

    def near(self, word: str, exact: int, longer: bool) -> Iterator[int]:
        """Numbers of the words that begin with the first `exact` letters of a word and go on as it does but for one replaced letter; longer: but for one more letter. Each comes once."""
        found = self._walk(self.root, 0, word[:exact])
        for at in range(exact, len(word) + longer):
            if found is None:
                return
            state, number = found
            right = word[at] if at < len(word) else ""
            rest = word[at:] if longer else word[at + 1 :]
            for c, (to, before) in self.edges[state].items():
                if c != right:
                    end = self._walk(to, number + before, rest)
                    if end and self.final[end[0]]:
                        yield end[1]
            found = self._walk(state, number, right) if right else None


def near_pairs(own: list[str], same: list[str], shorter: list[str], back: bool) -> Iterator[tuple[str, str, bool]]:
    """(a, b, longer): pairs of words at one error. own: the dictionary; same: words that ask it for one replaced letter; shorter: words that ask it for one letter more.

    Forward, the first half of the asking word is exact; back, the last, in the automaton of reversed words. What both directions would find counts forward only.
    """
    turn = (lambda w: w[::-1]) if back else (lambda w: w)
    known = sorted(turn(w) for w in own)
    automaton = Words(known)
    for words, longer in ((same, False), (shorter, True)):
        for word in words:
            half = len(word) // 2
            for number in automaton.near(turn(word), len(word) - half if back else half, longer):
                other = turn(known[number])
                if not back or len(os.path.commonprefix((word, other))) < half:
                    yield word, other, longer


_NEAR = T.StructType([T.StructField("word", T.StringType()), T.StructField("n_near", T.LongType()), T.StructField("best_n", T.LongType()), T.StructField("best", T.StringType())])


def _search(table: pa.Table) -> pa.Table:
    """What a shard finds for each of its words: the number of near words, and the best of them."""
    numbers: dict[str, int] = {}
    found: dict[str, list] = {}
    sides: dict[bool, tuple[list, list, list]] = {}
    for word, n, asks, back, own in zip(*(table.column(c).to_pylist() for c in ("word", "n", "asks", "back", "own")), strict=True):
        numbers[word] = n
        side = sides.setdefault(back, ([], [], []))
        side[1 + asks].append(word)
        if own:
            side[0].append(word)

    def note(a: str, b: str) -> None:
        has = found.setdefault(a, [0, (0, "")])
        has[0] += 1
        if not has[1][1] or (-numbers[b], b) < has[1]:
            has[1] = (-numbers[b], b)

    for back, (own, same, shorter) in sides.items():
        for a, b, longer in near_pairs(own, same, shorter, back):
            note(a, b)
            if longer:
                note(b, a)
    columns = [list(found), [x[0] for x in found.values()], [-x[1][0] for x in found.values()], [x[1][1] for x in found.values()]]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=_NEAR.names)


def _keys(word: Column, length: Column) -> Column:
    """The keys of a word that is looked for as one of `length` letters: the half that is exact, forward and back. Words of equal length and half are together."""
    half = F.floor((length - 1) / 2).cast("int")
    tail = length - 1 - half
    front, back = F.substring(word, F.lit(1), half), F.substring(word, F.char_length(word) - tail + 1, tail)
    return F.array(F.struct(F.lit(False).alias("back"), front.alias("half")), F.struct(F.lit(True).alias("back"), back.alias("half")))


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, n_near, best_n, best) for the words (word, n) that have near ones: how many, and the commonest of them, of equal ones the least.

    A word stands in the dictionary under its length and its first half, and its last. There it meets the words of its length, and those of one letter less that share that half and
    ask for one letter more; the shorter word's deletions are the longer one's insertions, so both get the pair. Keys are dealt to shards of about SHARD rows. A key of over `cell`
    words is dealt to cells: each of its words is in one, and asks in all.
    """
    size = F.char_length("word").cast("int")
    flat = words.select("word", "n", F.explode(F.array(F.struct(size.alias("length"), F.lit(0).alias("asks")), F.struct((size + 1).alias("length"), F.lit(1).alias("asks")))).alias("l"))
    flat = flat.select("word", "n", "l.length", "l.asks", F.explode(_keys(F.col("word"), F.col("l.length"))).alias("k")).select("word", "n", "asks", "k.back", F.xxhash64("length", "k.back", "k.half").alias("key"))
    rows, path = common.materialize(flat, "halves")
    busy, b_path = common.materialize(rows.where("asks = 0").groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > cell).select("key", F.ceil(F.col("m") / cell).cast("int").alias("cells")), "busy")
    shards = max(1, rows.count() // SHARD)
    columns = ("word", "n", "asks", "back", "own", "shard", "cell")
    dealt = rows.join(common.sized(busy.select("key")), "key", "left_anti").select("word", "n", "asks", "back", (F.col("asks") == 0).alias("own"), F.pmod("key", F.lit(shards)).alias("shard"), F.lit(0).alias("cell"))
    if not busy.isEmpty():
        spread = rows.join(common.sized(busy), "key").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        own = (F.col("asks") == 0) & (F.pmod(F.xxhash64("word"), F.col("cells")) == F.col("cell"))
        dealt = dealt.select(*columns).unionByName(spread.withColumn("own", own).withColumn("shard", F.col("key")).select(*columns))
    near, n_path = common.materialize(dealt.groupBy("shard", "cell").applyInArrow(_search, _NEAR), "near")
    common.discard(words.sparkSession, path, b_path)
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): each link is followed to its end, by doubling. A form is TIMES commoner than its word, so chains are short and end."""
    spark = forms.sparkSession
    now, path = common.materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(64):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new, new_path = common.materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not new.where("moved").isEmpty()
        common.discard(spark, path)
        now, path = new.select("word", "root"), new_path
        if not moved:
            return now
    raise RuntimeError("forms go round in circles")


def variants(df: DataFrame, text: str = "text", key: str = "doc_id", cell: int = CELL) -> DataFrame:
    """One row per word of df's texts: word, form, root, n, n_near, form_n.

    Words are counted as counts() has it; a null key counts as an empty one, null and empty texts have no words, repeated rows count as often as they occur. form is the near word (one
    letter inserted, deleted or replaced) of most occurrences, of equal ones the least by code points, if it has TIMES as many as the word or more; else form and form_n are null. root is the end of
    the chain of forms, the word itself without one. An empty table gives no rows. Columns other than text and key aren't looked at.
    """
    spark = df.sparkSession
    words, _ = common.materialize(counts(df, text, key), "words")
    near, _ = common.materialize(near_words(words, cell), "near")
    all_words = words.join(near, "word", "left")
    named = F.col("best_n") >= TIMES * F.col("n")
    out, _ = common.materialize(all_words.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(named, F.col("best")).alias("form"), F.when(named, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(out.where("form is not null").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.read(spark, sf_dir, "documents"))
