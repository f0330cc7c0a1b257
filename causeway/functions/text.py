"""Text expressions: cleaning, spans, sentences, markers, tokens and labels. All are native columns."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every pattern that models text gets these: case, Unicode classes, and only \n as a line end.
FLAGS = "(?iuUd)"

# The words that labels leave out.
STOPWORDS = (
    "a", "an", "the", "of", "in", "to", "and", "or", "for", "with",
    "on", "at", "by", "from", "as", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "that", "this", "it",
    "its", "they", "their", "not", "no", "more", "than", "which", "who",
    "new", "study", "research", "scientists", "researchers", "people",
    "human", "humans", "patient", "patients",
)


def strip(column: Column) -> Column:
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


@functools.cache
def _folds() -> tuple[str, str, str, str, int]:
    """From Unicode's own tables: the characters that one ASCII letter stands for and these letters; those that several stand for, and these, each as wide as the longest."""
    one, several = {}, {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        folded = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if folded:
            (one if len(folded) == 1 else several)[chr(code)] = folded
    width = max(map(len, several.values()))
    return "".join(one), "".join(one.values()), "".join(several), "".join(v.ljust(width, _PAD) for v in several.values()), width


#: Fills up folded letters; no character folds to it.
_PAD = "\x01"


def fold_unicode(column: Column) -> Column:
    """Letters without marks and compatibility forms as the letters they stand for; what has no ASCII form is dropped.

    Most characters have one letter and are translated at once. Where others are left, the text is taken apart, and each of them looked up in one constant.
    """
    singles, letters, several, packed, width = _folds()
    plain = F.translate(column, singles, letters)

    def letter(c: Column) -> Column:
        at = F.call_function("locate", c, F.lit(several))
        long = F.when(at > 0, F.rtrim(F.substring(F.lit(packed), (at - 1) * width + 1, F.lit(width)), F.lit(_PAD))).otherwise("")
        return F.when(F.ascii(c) < 128, c).otherwise(long)

    return F.when(~plain.rlike(r"[^\x00-\x7F]"), plain).otherwise(F.array_join(F.transform(F.split(plain, ""), letter), ""))


def normalize(column: Column) -> Column:
    """Lower case ASCII with single spaces and none at the ends."""
    return strip(F.regexp_replace(F.lower(fold_unicode(column)), r"\s+", " "))


#: Longest phrase, in characters.
LONGEST = 80


def clean_phrase(column: Column) -> Column:
    """A phrase without white space at the ends, trailing .,;:) and a leading article; over 80 characters cut to 80 and then before the last space, if any."""
    bare = F.regexp_replace(F.regexp_replace(strip(column), r"[.,;:)]+$", ""), r"(?iU)^(?:a|an|the)\s+", "")
    head = F.substring(bare, 1, LONGEST)
    cut = F.when(head.contains(" "), F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)).otherwise(head)
    return strip(F.when(F.length(bare) > LONGEST, cut).otherwise(bare))


def locate(part: Column, whole: Column, start: Column | None = None) -> Column:
    """Where part begins in whole, from 1, at start or later; 0 if nowhere."""
    return F.call_function("locate", part, whole, F.lit(1) if start is None else start)


def find(text: Column, phrase: Column) -> Column:
    """(start, end) of the first place of phrase in text, letter case aside; null if there is none. Counts from 0, end exclusive."""
    at = locate(F.lower(phrase), F.lower(text))
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(phrase)).alias("end")))


def span_or_start(text: Column, phrase: Column) -> Column:
    """As find(), but (0, length of the phrase) if there is none; found says which."""
    at = find(text, phrase)
    return F.struct(F.coalesce(at["start"], F.lit(0)).alias("start"), F.coalesce(at["end"], F.length(phrase)).alias("end"), at.isNotNull().alias("found"))


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def mark_pair(text: Column, s0: Column, e0: Column, s1: Column, e1: Column) -> Column:
    """text with <e0> and <e1> around two spans, in either order."""
    swap = s0 > s1
    first, last = (F.when(swap, s1).otherwise(s0), F.when(swap, e1).otherwise(e0)), (F.when(swap, s0).otherwise(s1), F.when(swap, e0).otherwise(e1))
    names = F.when(swap, "e1").otherwise("e0"), F.when(swap, "e0").otherwise("e1")
    around = lambda name, a, b: F.concat(F.lit("<"), name, F.lit(">"), cut(text, a, b), F.lit("</"), name, F.lit(">"))
    return F.concat(cut(text, F.lit(0), first[0]), around(names[0], *first), cut(text, first[1], last[0]), around(names[1], *last), cut(text, last[1], F.length(text)))


def relation_type(label: Column) -> Column:
    """The stored type of a model's label."""
    return F.when(label == "concausal", "countercausal").when(label == "no-rel", "no_rel").otherwise("causal")


def label_probabilities(source: Column) -> Column:
    """How sure each source of a pair is that there is no relation, a causal or a countercausal one."""
    said = lambda none, causal, counter: F.struct(F.lit(none).alias("p_none"), F.lit(causal).alias("p_causal"), F.lit(counter).alias("p_countercausal"))
    return F.when(source == "negation", said(0.0, 0.0, 1.0)).when(source == "regex", said(0.0, 1.0, 0.0)).otherwise(said(0.15, 0.80, 0.05))


def clean_generated(output: Column, fallback: Column) -> Column:
    """The first line of a model's answer without quotes, white space and final dots; fallback if nothing is left."""
    bare = F.regexp_replace(strip(output), "^[«»\"']+|[«»\"']+$", "")
    line = F.regexp_replace(strip(F.split(bare, "\n")[0]), r"\.+$", "")
    return F.coalesce(F.nullif(line, F.lit("")), fallback)


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the last."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


def tokens(column: Column) -> Column:
    """Runs of three or more letters a to z, in lower case."""
    return F.regexp_extract_all(F.lower(column), F.lit("[a-z]{3,}"), 0)


def words(column: Column) -> Column:
    """Runs of letters a to z and digits, in lower case."""
    return F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]+"), 0)


def words_of(text: str) -> list[str]:
    """words() of a Python string."""
    return re.findall("[a-z0-9]+", text.lower())


def prompt(template: str, text: Column, span: Column) -> Column:
    """template with {text} and {span} filled in; braces in the values are not read again."""
    made, rest = [], template
    while rest:
        at = [(rest.find(k), k, c) for k, c in (("{text}", text), ("{span}", span)) if k in rest]
        if not at:
            made.append(F.lit(rest))
            break
        i, k, c = min(at, key=lambda x: x[0])
        made += [F.lit(rest[:i]), c]
        rest = rest[i + len(k) :]
    return F.concat(*made)


def chat(system: str, examples: list[tuple[str, str]], user: Column) -> Column:
    """A list of messages (role, content): instructions, worked examples, the question."""
    fixed = [("system", system)] + [m for q, a in examples for m in (("user", q), ("assistant", a))]
    say = lambda role, content: F.struct(F.lit(role).alias("role"), (F.lit(content) if isinstance(content, str) else content).alias("content"))
    return F.array(*[say(*m) for m in fixed], say("user", user))


#: Sentences that are gathered at a time: an array that grows is copied each time.
RUN = 128


def sentences(text: Column) -> Column:
    """array of (sentence, start): cut after . ! or ? (a quote may follow) and white space, and at line ends; without white space at the ends and final dots.

    Each stands first in the text from where the one before ended. That is in its own piece of the text or in what is left of those before, so nothing else is searched, and the work grows with the text.
    """
    # a line end gets the dot that cuts there; nothing is taken out, so the pieces are the text but for these dots
    pieces = F.split(F.replace(text, F.lit("\n"), F.lit(".\n")), r"""(?U)(?<=[.!?])(?=["']?\s)""", -1)
    own = lambda p, i: F.when(i == 0, p).otherwise(F.regexp_replace(p, r"""(?U)^["']?\s+""", ""))
    bare = F.transform(pieces, lambda p, i: F.struct(p.alias("piece"), F.regexp_replace(strip(own(p, i)), r"\.+$", "").alias("sentence")))
    none = "cast(array() as array<struct<sentence: string, start: int>>)"
    # each value is made once: an expression that is used again would be computed again
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    state = lambda out, at, left: F.struct(out.alias("out"), at.alias("at"), left.alias("left"))

    def step(acc, x):
        """left: the text from `at` to the end of the piece before, with the dot of a line end that follows."""
        before = F.when(x["piece"].startswith("\n"), F.left(acc["left"], F.length(acc["left"]) - 1)).otherwise(acc["left"])
        n = F.length(x["sentence"])
        hit = lambda here: let(locate(x["sentence"], here), lambda k: state(F.array_append(acc["out"], F.struct(x["sentence"].alias("sentence"), (acc["at"] + k - 1).alias("start"))), acc["at"] + k - 1 + n, F.substring(here, k + n, F.length(here))))
        return let(F.concat(before, x["piece"]), lambda here: F.when(n == 0, state(acc["out"], acc["at"], here)).otherwise(hit(here)))

    def run(some, acc, i):
        found = F.aggregate(F.slice(some, i * RUN + 1, F.lit(RUN)), state(F.expr(none), acc["at"], acc["left"]), step)
        return let(found, lambda r: state(F.array_append(acc["out"], r["out"]), r["at"], r["left"]))

    runs = lambda some: F.sequence(F.lit(0), F.floor((F.size(some) - 1) / RUN).cast("int"))
    start = state(F.expr(f"slice(array({none}), 1, 0)"), F.lit(0), F.lit(""))
    return let(bare, lambda some: F.flatten(F.aggregate(runs(some), start, lambda acc, i: run(some, acc, i))["out"]))


def wrap(text: Column, width: int = 17) -> Column:
    """Lines of at most width characters where words allow it."""

    def step(acc, w):
        n = F.size(acc)
        last = F.get(acc, n - 1)
        fits = (n > 0) & (F.length(last) + 1 + F.length(w) <= width)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), w)))).otherwise(F.array_append(acc, w))

    return F.aggregate(F.split(text, " "), F.expr("cast(array() as array<string>)"), step)
