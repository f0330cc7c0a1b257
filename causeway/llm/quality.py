"""Quality classifier: a sparse ensemble of conjunctive rules, taken from trees over text statistics and weighted by lasso logistic regression."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that a fit uses at most, those of least hash; everything else covers all rows.
FIT_ROWS = 20_000
#: Rows of one fold of five are never learnt from.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


NAMES = ("log_chars", "word_length", "distinct_words", "word_variety", "distinct_lines", "line_length", "capitals", "digits", "symbols", "stops", "points", "repeats")


def statistics(text: str = "text") -> Column:
    """A struct of numbers about a whole text, named as in NAMES, each computed once. Null counts as the empty text."""

    def parts(t: Column) -> Column:
        return F.struct(t.alias("t"), F.split(t, r"[\s]+").alias("words"), F.split(t, "\n").alias("lines"))

    def sizes(p: Column) -> Column:
        n, words, lines = F.greatest(F.length(p["t"]), F.lit(1)), F.size(p["words"]), F.size(p["lines"])
        return F.struct(p["t"].alias("t"), n.cast("double").alias("n"), words.cast("double").alias("words"), lines.cast("double").alias("lines"), F.size(F.array_distinct(p["words"])).cast("double").alias("kinds"), F.size(F.array_distinct(p["lines"])).cast("double").alias("line_kinds"))

    def numbers(p: Column) -> Column:
        share = lambda pattern: F.regexp_count(p["t"], F.lit(pattern)) / p["n"]
        made = (
            F.log1p(F.length(p["t"])),
            p["n"] / p["words"],
            p["kinds"] / F.sqrt(p["words"]),
            p["kinds"] / p["words"],
            p["line_kinds"] / p["lines"],
            p["n"] / p["lines"],
            share(r"\p{Lu}"),
            share(r"[0-9]"),
            share(r"[#$%&*|<>{}\[\]=_~^@\\+]"),
            share(r"[!?]"),
            share(r"[.,;:]"),
            F.regexp_count(p["t"], F.lit(r"(?<!\S)(\S++)(?: \1(?!\S))+")) / p["words"],
        )
        return F.struct(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in zip(NAMES, made, strict=True)])

    return common.let(common.let(common.let(common.whole_text(text), parts), sizes), numbers)


@dataclass(frozen=True)
class Rule:
    """A conjunction of comparisons: (statistic, True for greater, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[k] > v) if above else (x[k] <= v) for k, above, v in self.terms])

    def column(self, stats: Column) -> Column:
        return reduce(lambda a, b: a & b, [(stats[k] > F.lit(v)) if above else (stats[k] <= F.lit(v)) for k, above, v in self.terms])


@dataclass(frozen=True)
class Ensemble:
    """intercept + the weights of the rules that hold, through the logistic function."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        z = np.full(len(next(iter(x.values()))), self.intercept)
        for rule, w in self.rules:
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: Column) -> Column:
        z = F.lit(self.intercept)
        for rule, w in self.rules:
            z = z + F.when(rule.column(stats), F.lit(w)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """(gain, feature, threshold) of the best cut for gradients g and weights h, or None."""
    best = None
    whole = g.sum() ** 2 / (h.sum() + 1)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, cg, ch = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[:-1] < v[1:])
        at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
        if not len(at):
            continue
        gain = cg[at] ** 2 / (ch[at] + 1) + (cg[-1] - cg[at]) ** 2 / (ch[-1] - ch[at] + 1) - whole
        k = int(np.argmax(gain))
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), j, float((v[at[k]] + v[at[k] + 1]) / 2))
    return best


def tree_rules(x: np.ndarray, names: list[str], y: np.ndarray, trees: int = 24, depth: int = 3, least: int = 8, rate: float = 0.3, seed: int = 5) -> list[Rule]:
    """The paths of boosted trees from the root to every node, as rules. Each tree sees half of the rows."""
    rng, z, rules = np.random.default_rng(seed), np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        used = np.sort(rng.permutation(len(y))[: max(2 * least, len(y) // 2)])
        todo = [((), used, np.arange(len(y)))]
        while todo:
            terms, inside, rows = todo.pop()
            cut = _split(x[inside], g[inside], h[inside], least) if len(terms) < depth and len(inside) >= 2 * least else None
            if terms:
                rules.setdefault(Rule(terms), None)
            if cut is None:
                z[rows] += rate * g[inside].sum() / (h[inside].sum() + 1)
                continue
            _, j, v = cut
            for above in (False, True):
                keep = (lambda r, j=j, v=v, above=above: (x[r, j] > v) == above)
                todo.append((terms + ((names[j], above, v),), inside[keep(inside)], rows[keep(rows)]))
    return list(rules)


def lasso(f: np.ndarray, y: np.ndarray, strength: float = 2e-3, rounds: int = 800) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute-value penalty on all weights but the intercept, by accelerated proximal steps."""
    n, m = f.shape
    a = np.hstack([np.ones((n, 1)), f])
    step = 4 * n / (np.linalg.norm(a, 2) ** 2)
    w = u = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-a @ u))
        v = u - step * (a.T @ (p - y)) / n
        v[1:] = np.sign(v[1:]) * np.maximum(np.abs(v[1:]) - step * strength, 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u = v + (t - 1) / s * (v - w)
        if np.abs(v - w).max() < 1e-7:
            w = v
            break
        w, t = v, s
    return float(w[0]), w[1:]


def fit(x: dict[str, np.ndarray], y: np.ndarray) -> Ensemble:
    """An ensemble for statistics x and labels y. Without rows it says 0.5 of everything; with one class only, nearly that class."""
    if not len(y):
        return Ensemble(0.0, ())
    if y.min() == y.max():
        return Ensemble(4.0 if y[0] else -4.0, ())
    names = list(x)
    table = np.column_stack([x[k] for k in names])
    rules = tree_rules(table, names, y)
    if not rules:
        return Ensemble(float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), ())
    intercept, w = lasso(np.column_stack([r.holds(x) for r in rules]).astype(float), y)
    return Ensemble(intercept, tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6))


def fold(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", rows: int = FIT_ROWS) -> Ensemble:
    """Fits on the rows of labels (key, quality) outside the held-out fold; rows without key or quality don't count.

    At most `rows` labelled rows are used, those with the least hash of their key. Their ids, a bounded table, are broadcast, so texts aren't shuffled; their
    statistics, as many rows of a dozen numbers, come to the driver.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col(key).isNotNull() & F.col("quality").isin(0, 1) & (fold(key) != HELD_OUT)).select(key, "quality")
    picked = usable.orderBy(F.xxhash64(key), key, "quality").limit(rows)
    chosen = F.broadcast(spark.createDataFrame(picked.collect(), picked.schema))
    found = docs.select(key, text).join(chosen, key).select(key, "quality", statistics(text).alias("_s")).select(key, "quality", "_s.*").toPandas()
    found = found.sort_values([key, "quality", "log_chars"], kind="stable")
    return fit({k: found[k].to_numpy(float) for k in NAMES}, found["quality"].to_numpy(float))


def score(docs: DataFrame, model: Ensemble, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the model's score of every whole text; nothing but the text goes into it. A column named `out` is replaced."""
    return docs.withColumn(out, common.let(statistics(text), model.column))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (F.coalesce(fold(), F.lit(-1)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
