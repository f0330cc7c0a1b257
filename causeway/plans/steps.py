"""The four steps as functions of DataFrames, and the registry that finds an implementation by name.

Detectors take posts and give posts. Extractors take posts and give relations. Canonizers take (text, start, end) columns and give a column.
Inferrers take relations and give (clusters, members).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import workers
from ..functions import text as X
from ..sources.store import settled
from . import patterns as P
from . import vectors as V

_REGISTRY: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str):
    """Makes a function known as the implementation `name` of a step: detect, extract, canonize or infer."""

    def keep(f: Callable) -> Callable:
        if not callable(f):
            raise TypeError(f"{kind} {name} can't be called")
        _REGISTRY[kind, name] = f
        return f

    return keep


def build(kind: str, config: dict) -> Callable[..., object]:
    """The implementation that config names, with its other keys as options; keys that it doesn't know are ignored."""
    options = dict(config)
    name = options.pop("implementation")
    if (kind, name) not in _REGISTRY:
        raise TypeError(f"no {kind} implementation is called {name}")
    f = _REGISTRY[kind, name]
    known = f.__code__.co_varnames[: f.__code__.co_argcount + f.__code__.co_kwonlyargcount]
    return lambda *args: f(*args, **{k: v for k, v in options.items() if k in known})


def _any(column: Column, patterns: tuple[str, ...]) -> Column:
    return column.rlike(X.FLAGS + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def is_causal(title: Column) -> Column:
    """Nothing rules the title out, and some pattern, explicit or implicit, is in it. Null is no claim."""
    return F.coalesce(~_any(title, P.EXCLUDED) & _any(title, P.EXPLICIT + P.IMPLICIT), F.lit(False))


@register("detect", "regex")
def detect(posts: DataFrame, text: str = "title") -> DataFrame:
    return posts.where(is_causal(F.col(text)))


@register("detect", "model")
def detect_with_model(posts: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], text: str = "title", label: str = "causal") -> DataFrame:
    """Posts that a model labels `causal`. load() makes the model, once per worker and batch iterator."""
    workers.ship(posts.sparkSession)

    @F.pandas_udf("string")
    def labels(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series(model(b.fillna("").tolist()))

    return posts.withColumn("_label", labels(F.col(text))).where(F.col("_label") == label).drop("_label")


def pair(title: Column, study_first: bool = False) -> Column:
    """(cause, effect, kind) of the first pattern whose phrases are both there and differ after cleaning; null if none fits. kind: negation or regex.

    Patterns are tried in turn: a title that one fits isn't matched with the later ones, and one whose cause isn't there isn't searched for the effect.
    """
    affirmed = list(P.AFFIRMED)
    if study_first:
        affirmed.insert(0, affirmed.pop(P.REPORT))

    def attempt(kind: str, pattern: str, cause: int, effect: int) -> Column:
        group = lambda g: F.regexp_extract(title, X.FLAGS + pattern, g)
        cleaned = lambda c: F.struct(X.clean_phrase(c).alias("cause"), X.clean_phrase(group(effect)).alias("effect"), F.lit(kind).alias("kind"))
        fits = lambda s: F.when((s["cause"] != "") & (s["effect"] != "") & (s["cause"] != s["effect"]), s)
        return V.let(group(cause), lambda c: F.when(c != "", V.let(cleaned(c), fits)))

    return F.coalesce(*[attempt(kind, *row) for kind, rows in (("negation", P.NEGATED), ("regex", affirmed)) for row in rows])


def _typed(found: DataFrame) -> DataFrame:
    """Pairs (cause_text, effect_text, kind, relation_type, extractor, confidence) with their norms."""
    return found.withColumns({f"{r}_norm": X.normalize(F.col(f"{r}_text")) for r in ("cause", "effect")})


@register("extract", "regex")
def extract(posts: DataFrame, text: str = "title", study_first: bool = False, fallback: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """posts' columns and cause_text, effect_text, their norms, kind, relation_type, extractor and confidence, for posts that a pattern fits; those that none fits go to a second extractor, if one is given."""
    # made by a generator: a filter on a column would be moved below it and match every title again
    tried = posts.select("*", F.explode_outer(F.array(pair(F.col(text), study_first))).alias("_pair"))
    found = tried.where("_pair is not null").select(*posts.columns, F.col("_pair.cause").alias("cause_text"), F.col("_pair.effect").alias("effect_text"), F.col("_pair.kind").alias("kind"))
    first = _typed(found.withColumns({"relation_type": F.when(F.col("kind") == "negation", "countercausal").otherwise("causal"), "extractor": F.lit("regex"), "confidence": F.lit(1.0)}))
    return first if fallback is None else first.unionByName(fallback(tried.where("_pair is null").select(*posts.columns)))


#: What a plug-in extractor gives for a title: any number of (cause, effect, relation type, confidence).
Pairs = list[tuple[str, str, str, float]]


@register("extract", "table")
def extract_with(posts: DataFrame, load: Callable[[], Callable[[str], Pairs]], text: str = "title", name: str = "table") -> DataFrame:
    """As extract(), by a plug-in: load() makes the extractor once for each task, and it is joined laterally, so a title has as many rows as it gives.

    A title on which it fails, or for which it gives what is no pair, has no rows; all others keep theirs. Empty phrases, and pairs of equal ones, are no pairs.
    """
    workers.ship(posts.sparkSession)

    @F.udtf(returnType="cause_text string, effect_text string, relation_type string, confidence double", useArrow=True)
    class Extractor:
        def __init__(self):
            self.find = load()

        def eval(self, title: str):
            try:
                rows = [(str(c), str(e), str(kind), float(sure)) for c, e, kind, sure in (self.find(title) if title else [])]
            except Exception:
                return
            yield from rows

    found = posts.lateralJoin(Extractor(F.col(text).outer()))
    valid = found.where("cause_text <> '' and effect_text <> '' and cause_text <> effect_text and relation_type in ('no_rel', 'causal', 'countercausal')")
    return _typed(valid.withColumns({"kind": F.lit(name), "extractor": F.lit(name)}))


def entity_pairs(posts: DataFrame, entities: str = "entities") -> DataFrame:
    """Every ordered pair of different entities (start, end) of a post, with the title marked for a pair classifier. Posts of fewer than two have none."""
    some = posts.where(F.size(entities) >= 2)
    first = some.select("*", F.posexplode(entities).alias("_i", "_a"))
    both = first.select("*", F.posexplode(entities).alias("_j", "_b")).where("_i <> _j")
    return both.withColumn("marked", X.mark_pair(F.col("title"), F.col("_a.start"), F.col("_a.end"), F.col("_b.start"), F.col("_b.end"))).withColumns({"cause_text": X.cut(F.col("title"), F.col("_a.start"), F.col("_a.end")), "effect_text": X.cut(F.col("title"), F.col("_b.start"), F.col("_b.end"))}).drop("_a", "_b", "_i", "_j")


def best_label(scores: Column) -> Column:
    """The (label, score) of greatest score of an array of them; of equal ones the least label."""
    return F.element_at(F.array_sort(F.transform(scores, lambda s: F.struct((-s["score"]).alias("k"), s["label"].alias("label"), s["score"].alias("score")))), 1)


@register("extract", "model")
def extract_with_models(posts: DataFrame, entities: Callable[[Column], Column], classify: Callable[[Column], Column], include_no_rel: bool = False) -> DataFrame:
    """Pairs of the entities that one model finds, typed by another. entities: title to array<struct<start, end>>; classify: marked title to array<struct<label, score>>. Pairs without relation are left out unless asked for."""
    pairs = entity_pairs(posts.withColumn("entities", entities(F.col("title"))))
    scored = pairs.withColumn("_s", classify(F.col("marked")))
    best = best_label(F.col("_s"))
    typed = scored.withColumns({"relation_type": X.relation_type(best["label"]), "confidence": best["score"], "extractor": F.lit("model")}).drop("_s", "entities", "marked")
    valid = typed.where((F.col("cause_text") != "") & (F.col("effect_text") != "") & (F.col("cause_text") != F.col("effect_text")))
    return valid if include_no_rel else valid.where("relation_type <> 'no_rel'")


@register("canonize", "passthrough")
def passthrough(text: Column, start: Column, end: Column) -> Column:
    return X.cut(text, start, end)


def canonize(relations: DataFrame, canonizer: Callable[[Column, Column, Column], Column] = passthrough, text: str = "title") -> DataFrame:
    """relations with canonical forms of both phrases and whether each was found in the text. A phrase that isn't there is canonized as the text's first characters, as many."""
    out = relations
    for side in ("cause", "effect"):
        span = X.span_or_start(F.col(text), F.col(f"{side}_text"))
        out = out.withColumn(f"{side}_canonical", canonizer(F.col(text), span["start"], span["end"])).withColumn(f"{side}_found", span["found"])
    return out


def canonize_distinct(relations: DataFrame, model: Callable[[DataFrame], DataFrame], text: str = "title") -> DataFrame:
    """As canonize(), for costly models: each distinct (text, phrase in lower case) is sent once and its answer joined back. model: adds output to (text, span)."""
    out = relations
    for side in ("cause", "effect"):
        key = F.lower(f"{side}_text")
        asked = relations.select(F.col(text).alias("text"), F.col(f"{side}_text").alias("span"), key.alias("key")).groupBy("text", "key").agg(F.min("span").alias("span"))
        said = model(asked).select(F.col("text").alias(text), "key", X.clean_generated(F.col("output"), F.col("span")).alias(f"{side}_canonical"))
        out = out.withColumn("key", key).join(said, [text, "key"], "left").drop("key").withColumn(f"{side}_canonical", F.coalesce(f"{side}_canonical", f"{side}_text"))
    return out


def events(relations: DataFrame, *others: str) -> DataFrame:
    """(relation_id, role, norm, text) and other columns: both ends of each relation in one pass; text is the canonical form, else the phrase, else the norm."""
    side = lambda r: F.struct(F.lit(r).alias("role"), F.col(f"{r}_norm").alias("norm"), X.first_of(F.col(f"{r}_canonical"), F.col(f"{r}_text"), F.col(f"{r}_norm")).alias("text"))
    return relations.select(F.col("id").alias("relation_id"), F.explode(F.array(side("cause"), side("effect"))).alias("e"), *others).select("relation_id", "e.role", "e.norm", "e.text", *others)


def unique_events(relations: DataFrame) -> DataFrame:
    """(norm, text, first): each norm once, with the text it had first (by relation, cause before effect)."""
    # numbers are kept by hash, while a text to be kept would have all events sorted; then one relation is looked up for each norm, in a table whose size is known
    first = settled(events(relations).groupBy("norm").agg(F.min("relation_id").alias("first")), "firsts")
    said = events(relations.join(first.select(F.col("first").alias("id"), F.struct("norm", "first").alias("_of")), "id"), "_of")
    own = said.where(F.col("norm").eqNullSafe(F.col("_of.norm")))
    return own.groupBy("_of").agg(F.min_by("text", F.struct(F.col("role") != "cause", "text")).alias("text")).select("_of.norm", "text", "_of.first")


def top_words(texts: DataFrame, group: str, text: str = "text", n: int = 3) -> DataFrame:
    """(group, label): the n most frequent words of each group's texts, stop words left out, joined by ' / '; ties by word; unlabeled if none is left."""
    words = texts.select(group, F.explode(X.tokens(F.col(text))).alias("w")).where(~F.col("w").isin(*X.STOPWORDS))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), "w"))
    best = words.groupBy(group, "w").agg(F.count("*").alias("n")).withColumn("r", rank).where(F.col("r") <= n)
    labels = best.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda s: s["w"]), " / ").alias("label"))
    return texts.select(group).distinct().join(labels, group, "left").withColumn("label", F.coalesce("label", F.lit("unlabeled")))
