"""Personal data: labelers vote on spans, expectation-maximisation weighs them, and a classifier trained on its output decides."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The kinds, in the order that settles ties of start; the first four have fixed rules, the others are the method's.
KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE = 4
YES, NO, ABSTAIN = 1, 0, 2

#: Top-level domains, dialling codes and cue words that the gazetteer and context labelers know.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "91")
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "2221", "35", "36", "38", "30")
CUES = re.compile(r"(?i)(token|secret|key|passw|pwd|auth|bearer|mail|contact|phone|tel|call|mobil|fax|card|visa|karte|tarjeta|carte|account|iban|ssn|host|addr|\bip\b|from|login)")
ANTICUES = re.compile(r"(?i)(version|v\.|page|isbn|vol|no\.|chapter|figure|table|commit|sha|checksum|md5)")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![0-9A-Za-z_])[0-9A-Za-z_-]{24,}+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches. Every match has an @, so only the runs around them are looked at: the time is linear."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of what the fixed rules accept, and of what has the form but fails the test of its kind."""
    good = [(0, *x) for x in emails(text)] if "@" in text else []
    bad: list[tuple[int, int, int]] = []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            ok = all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))
            (good if ok else bad).append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 9:
                d = _digits(m[0])
                if 12 <= len(d) <= 19 and luhn(d):
                    good.append((2, m.start(), m.end()))
                elif len(d) >= 9:
                    bad.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                (good if 9 <= len(_digits(m[0])) <= 15 else bad).append((3, m.start(), m.end()))
    return sorted(good, key=lambda s: (s[1], s[0])), bad


def _apart(spans: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Those of `spans` (kind, start, end), by start, that overlap nothing taken and none before them that is kept. One sweep over both after sorting."""
    out, last, i, reach = [], 0, 0, 0
    taken = sorted(taken)
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        while i < len(taken) and taken[i][0] <= start:
            reach = max(reach, taken[i][1])
            i += 1
        if start >= max(last, reach) and (i == len(taken) or end <= taken[i][0]):
            out.append((kind, start, end))
            last = end
    return out


def candidates(text: str, good: list, bad: list) -> list[tuple[int, int, int]]:
    """Spans beyond the fixed rules that the labelers shall judge: long tokens with digits, and numbers that failed a test."""
    taken, secrets = [(a, b) for _, a, b in good], []
    if _DIGIT.search(text):
        found = [(4, *m.span()) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
        secrets = _apart(found, taken)
    return secrets + _apart([(5, a, b) for _, a, b in bad], taken + [(a, b) for _, a, b in secrets])


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """What the six labelers say of a span: its form, its check digits, its length, a gazetteer, the words before it, the spread of its characters."""
    span, before = text[start:end], text[max(0, start - 24) : start]
    digits = _digits(span)
    form = YES if kind < BASE or (kind == 4 and re.fullmatch(r"[A-Za-z0-9_-]{24,}", span)) else NO
    check = (YES if luhn(digits) else NO) if 12 <= len(digits) <= 19 and kind in (2, 5) else ABSTAIN
    length = {0: YES if len(span) <= 64 else NO, 1: YES if len(span) <= 15 else NO, 2: YES if len(digits) in (15, 16) else NO, 3: YES if 10 <= len(digits) <= 13 else NO, 4: YES if len(span) in (32, 36, 40, 64) else ABSTAIN, 5: YES if len(digits) in (9, 15, 16) else NO}[kind]
    if kind == 0:
        known = YES if span.rpartition(".")[2].lower() in DOMAINS else ABSTAIN
    elif kind == 1:
        known = NO if span.split(".")[0] in ("0", "127", "255") else YES
    elif kind == 3:
        known = YES if digits.startswith(CODES) else NO
    elif kind == 4:
        known = ABSTAIN
    else:
        known = YES if digits.startswith(CARD_STARTS) else NO
    context = NO if ANTICUES.search(before) else YES if CUES.search(before) else ABSTAIN
    spread = YES if len(set(span)) >= 6 else NO
    return form, check, length, known, context, spread


LABELERS = ("form", "check", "length", "gazetteer", "context", "spread")
#: A span's votes and kind as one number: kind * 3^6 + the votes in base three.
PATTERNS = len(KINDS) * 3 ** len(LABELERS)


def pattern(kind: int, said: tuple[int, ...]) -> int:
    p = kind
    for v in said:
        p = p * 3 + v
    return p


def unpack(p: int) -> tuple[int, tuple[int, ...]]:
    said = []
    for _ in LABELERS:
        p, v = divmod(p, 3)
        said.append(v)
    return p, tuple(reversed(said))


SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pattern", T.IntegerType())])


def spans_of(text: str) -> list[dict]:
    good, bad = base_spans(text)
    return [{"kind": k, "start": a, "end": b, "pattern": pattern(k, votes(text, k, a, b))} for k, a, b in [*good, *candidates(text, good, bad)]]


@F.arrow_udf(T.ArrayType(SPAN))
def _spans(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32())]))
    return pa.array([spans_of(t) if t else [] for t in texts.to_pylist()], kind)


def reliabilities(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """Expectation-maximisation over how often each vote pattern occurs: the chance that a span of each pattern is personal data, and
    per labeler the chances of a yes for spans that are and that aren't. Kinds have their own share; labelers that abstain say nothing."""
    keys = sorted(counts)
    if not keys:
        return {}, np.full((len(LABELERS), 2), 0.5)
    n = np.array([counts[k] for k in keys], float)
    kinds = np.array([unpack(k)[0] for k in keys])
    said = np.array([unpack(k)[1] for k in keys])
    yes, known = (said == YES).astype(float), (said != ABSTAIN).astype(float)
    q = np.clip((yes.sum(1) + 0.5) / (known.sum(1) + 1), 0.05, 0.95)
    says = np.full((len(LABELERS), 2), 0.5)
    for _ in range(rounds):
        for c, w in ((0, n * q), (1, n * (1 - q))):
            says[:, c] = (w @ yes + (2.0, 1.0)[c]) / (w @ known + 3.0)
        share = np.array([((n * q)[kinds == k].sum() + 1) / (n[kinds == k].sum() + 2) for k in range(len(KINDS))])
        logit = np.log(share / (1 - share))[kinds]
        for c, sign in ((0, 1), (1, -1)):
            p = np.clip(says[:, c], 1e-3, 1 - 1e-3)
            logit = logit + sign * (yes @ np.log(p) + (known - yes) @ np.log(1 - p))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - q).max() < 1e-9:
            q = new
            break
        q = new
    return dict(zip(keys, q.tolist(), strict=True)), says


def span_classifier(counts: dict[int, int], rounds: int = 400) -> dict[int, float]:
    """Logistic regression on kind, votes and abstentions, trained on the chances that reliabilities() gives, weighted by occurrence.

    Returns the chance for each pattern that occurs. The training data are at most PATTERNS weighted rows whatever the corpus holds.
    """
    target, _ = reliabilities(counts)
    keys = sorted(counts)
    if not keys:
        return {}
    x = np.array([[1.0, *(float(unpack(k)[0] == j) for j in range(len(KINDS))), *(float(v == YES) - float(v == NO) for v in unpack(k)[1])] for k in keys])
    y, w = np.array([target[k] for k in keys]), np.array([counts[k] for k in keys], float)
    w = np.sqrt(w) / np.sqrt(w).sum()
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ b))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - 1e-3 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(keys, (1 / (1 + np.exp(-x @ b))).tolist(), strict=True))


def find(df: DataFrame, text: str = "text", spans: str = "spans", sure: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with an array of spans (kind, start, end, base) in order of start and kind.

    Starts and ends count code points, ends are exclusive. What the fixed rules accept is always there; other spans are there if the classifier's
    chance is `sure` or more. Null and empty texts have no spans; very long texts take linear time; rows are independent but for the
    vote counts, which cover all rows. A column of the same name is replaced. Only the table of vote patterns, of bounded size, comes to the driver.
    """
    common.small_batches(df.sparkSession)
    kept = [c for c in (keep if keep is not None else df.columns) if c != spans]
    seen, _ = common.materialize(df.withColumn(spans, _spans(common.whole_text(text))).select(*kept, spans), "pii")
    rows = seen.select(F.explode(f"{spans}.pattern").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()
    chance = span_classifier({r["p"]: r["n"] for r in rows})
    accepted = common.literal(sorted(p for p, c in chance.items() if c >= sure), "int")
    good = F.filter(spans, lambda s: (s["kind"] < BASE) | F.array_contains(accepted, s["pattern"]))
    ordered = F.array_sort(F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = common.literal(list(KINDS), "string")
    return seen.withColumn(spans, F.transform(ordered, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (s["kind"] < BASE).alias("base"))))


@F.arrow_udf(T.StringType())
def _replaced(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        parts, at = [], 0
        for s in found or ():
            if s["start"] >= at:
                parts += [text[at : s["start"]], "[", s["kind"], "]"]
            at = max(at, s["end"])
        out.append("".join([*parts, text[at:]]) if found else text)
    return pa.array(out, pa.string())


def redact(df: DataFrame, text: str = "text", sure: float = 0.5) -> DataFrame:
    """df with [kind] in place of every span in its texts; where spans overlap, their union is replaced, named after the first.

    Texts without spans stay as they are, null ones null. All columns stay, whatever their names. Time is linear in text and spans.
    """
    spans = common.free_names(df, "spans")["spans"]
    found = find(df, text, spans, sure)
    return found.withColumn(text, _replaced(F.col(text).cast("string"), F.col(spans))).drop(spans)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    word = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:BASE]]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, word), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", word), ",").alias("spans"))
