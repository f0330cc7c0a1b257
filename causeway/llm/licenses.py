"""License scans: an exact set-similarity join of text blocks with license templates by token containment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A word: anything but ASCII characters other than lower-case letters and digits, after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed values: (label, words, True if the words must stand consecutively).
TEMPLATES = (
    ("mit", "mit license", True),
    ("apache", "apache license", True),
    ("gpl", "general public license", True),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", False),
    ("apache", "licensed under the apache license version 2 0", False),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", False),
    ("gpl", "this work is licensed under the gnu general public license version 3", False),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", False),
    ("cc-by-nc", "licensed under cc by nc 4 0", False),
)
THRESHOLD = 0.8
#: A block is STRIDE words and as many of the following ones as the longest template has, less one.
STRIDE = 32


def _templates(templates, threshold: float, counts: dict[str, int]) -> list[dict]:
    """Templates with their distinct words in global order (rarest first, then by word), the least overlap and the prefix that any match must touch."""
    out = []
    for i, (label, words, consecutive) in enumerate(templates):
        phrase = words.split()
        tokens = sorted(set(phrase), key=lambda w: (counts.get(w, 0), w))
        need = len(tokens) if consecutive else math.ceil(threshold * len(tokens) - 1e-9)
        out.append({"id": i, "label": label, "phrase": phrase, "tokens": tokens, "need": need, "prefix": tokens[: len(tokens) - need + 1], "consecutive": consecutive})
    return out


def words_of(text: str = "text"):
    return F.regexp_extract_all(common.ascii_lower(common.whole_text(text)), F.lit(WORD), 0)


def token_counts(df: DataFrame, tokens: list[str], text: str = "text") -> dict[str, int]:
    """In how many texts each template token stands, over all texts. At most one row per template token comes to the driver."""
    found = df.select(F.explode(F.array_intersect(words_of(text), common.literal(tokens, "string"))).alias("w"))
    return {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def scan(df: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, stride: int = STRIDE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of df: the columns `keep`, n_words, and matches, an array of (label, start, score, base).

    Every text is cut into blocks of words that overlap by the longest template less one word. A block matches a template if it has at least the
    share `threshold` of the template's distinct words; templates marked consecutive need all of their words and are then kept only where they stand
    one after another, each place once (base). Tokens are ordered by how many texts have them; a block can only match a template if it has a
    token of the template's prefix (all but the last need - 1 tokens in that order): only such blocks become rows. They are joined with the
    prefix table by token; the length filter asks for as many template tokens in the block as the template needs, the positional filter for as many from the shared token on,
    in both orders (the row of the first shared token always passes it if the pair matches); what passes is counted exactly. start counts words from 0, score is the containment.

    Null and empty texts have no words and no matches. Repeated rows each have their own result. Template tables are bounded by the
    parameter, so they are broadcast; texts never leave their task: only candidate blocks do.
    """
    spark = df.sparkSession
    vocabulary = sorted({w for _, words, _ in templates for w in words.split()})
    counts = token_counts(df, vocabulary, text)
    made = _templates(templates, threshold, counts)
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    reach = max(len(t["phrase"]) for t in made) - 1
    starts = common.literal(sorted({w for t in made for w in t["prefix"]}), "string")
    known = common.literal(vocabulary, "string")

    narrow = df.select(F.struct(*keep).alias("_own"), words_of(text).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(starts, w), i)), lambda i: i.isNotNull())
    hits = F.when(F.arrays_overlap("words", starts), hits).otherwise(F.expr("cast(array() as array<int>)"))
    # a word belongs to the block it stands in and, near its start, to the tail of the blocks before
    back = math.ceil(reach / stride)
    owners = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.sequence(F.greatest(F.lit(0), F.floor(i / stride).cast("int") - back), F.floor(i / stride).cast("int")))))
    blocks = F.transform(owners, lambda b: F.struct((b * stride).alias("start"), F.slice(F.col("words"), b * stride + 1, stride + reach).alias("words")))
    rows = narrow.select("_own", F.monotonically_increasing_id().alias("_row"), F.size("words").cast("long").alias("n_words"), blocks.alias("blocks"))
    rows, _ = common.materialize(rows, "blocks")

    prefixes = F.broadcast(spark.createDataFrame([(w, t["id"]) for t in made for w in t["prefix"]], "token string, template int"))
    facts = F.broadcast(spark.createDataFrame([(t["id"], t["label"], t["phrase"], t["tokens"], [place[w] for w in t["tokens"]], t["need"], t["consecutive"]) for t in made], "template int, label string, phrase array<string>, tokens array<string>, places array<int>, need int, consecutive boolean"))
    block = rows.select("_row", F.explode("blocks").alias("b")).select("_row", "b.start", "b.words", F.array_intersect("b.words", known).alias("have"))
    asked = block.withColumn("token", F.explode(F.array_intersect("have", starts))).join(prefixes, "token").join(facts, "template")
    ranks = F.create_map(*[F.lit(x) for w in order for x in (w, place[w])])
    have_places = F.transform("have", lambda w: F.element_at(ranks, w))
    rank = F.element_at(ranks, F.col("token"))
    behind = F.least(F.size(F.filter("places", lambda p: p >= rank)), F.size(F.filter(have_places, lambda p: p >= rank)))
    passed = asked.where((F.size("have") >= F.col("need")) & (behind >= F.col("need")))
    shared = F.array_intersect("have", "tokens")
    # of the shared prefix tokens only the first in global order answers for the pair
    first = F.array_min(F.transform(shared, lambda w: F.element_at(ranks, w))) == rank
    met = passed.where(first & (F.size(shared) >= F.col("need"))).withColumn("score", F.size(shared) / F.size("tokens"))
    spots = F.sequence(F.lit(0), F.least(F.lit(stride), F.size("words")) - 1)
    stands = F.filter(spots, lambda i: F.slice(F.col("words"), i + 1, F.size("phrase")) == F.col("phrase"))
    places = F.when(F.col("consecutive"), F.transform(stands, lambda i: F.col("start") + i)).otherwise(F.array("start"))
    matches = met.select("_row", "label", "score", "consecutive", F.explode(places).alias("start"))
    packed = matches.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "label", F.col("consecutive").alias("base"), "score"))).alias("matches"))
    empty = F.expr("cast(array() as array<struct<start: int, label: string, base: boolean, score: double>>)")
    return rows.drop("blocks").join(packed, "_row", "left").select("_own.*", "n_words", F.coalesce("matches", empty).alias("matches"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.read(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"].cast("long"))
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    rows = ", ".join(f"({i}, '{label}', [{', '.join(repr(w) for w in phrase.split())}], {str(base).lower()})" for i, (label, phrase, base) in enumerate(TEMPLATES))
    reach = max(len(phrase.split()) for _, phrase, _ in TEMPLATES) - 1
    return f"""
WITH templates AS (SELECT *, list_distinct(phrase) tokens FROM (VALUES {rows}) v(id, label, phrase, base)),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') w FROM documents),
places AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: list_slice(w, i + 1, i + len(phrase)) = phrase)) p FROM docs, templates WHERE base AND list_has_all(w, tokens)),
blocks AS (SELECT doc_id, list_distinct(list_slice(w, b + 1, b + {STRIDE + reach})) words FROM (SELECT doc_id, w, unnest(range(0, len(w), {STRIDE})) b FROM docs)),
loose AS (SELECT doc_id, label, len(list_intersect(words, tokens)) / len(tokens) score FROM blocks, templates WHERE NOT base AND len(list_intersect(words, tokens)) >= ceil({THRESHOLD} * len(tokens) - 1e-9)),
said AS (SELECT doc_id, label, 1.0::double score, p, true AS base FROM places UNION ALL SELECT doc_id, label, score, NULL, false FROM loose)
SELECT d.doc_id, len(any_value(w))::bigint n_words, count(p)::bigint n_base, min(p)::bigint first_word, max(p)::bigint last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') labels, coalesce(max(score), 0)::double score
FROM docs d LEFT JOIN said USING (doc_id) GROUP BY 1"""


SQL = _sql()
