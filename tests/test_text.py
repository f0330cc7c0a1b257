"""Text expressions against Python's own re and str."""

import random
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from causeway.functions import text as X
from causeway.plans import analyze, patterns, steps


def one(spark, build, *values):
    names = [f"c{i}" for i in range(len(values[0]))]
    df = spark.createDataFrame([tuple(v) for v in values], ", ".join(f"{n} string" for n in names)).withColumn("_i", F.monotonically_increasing_id())
    return [r[0] for r in df.select(build(*[F.col(n) for n in names]), "_i").orderBy("_i").collect()]


PHRASES = [
    ("  the tea ", "tea"),
    ("The\ttea", "tea"),
    ("AN apple).;", "apple"),
    ("a an apple", "an apple"),
    ("theme park,", "theme park"),
    ("x.,;:)", "x"),
    (".,;", ""),
    ("", ""),
    ("(aside) tea (cold)", "(aside) tea (cold"),
    ("tea. and milk", "tea. and milk"),
    ("word " * 16 + "tail", ("word " * 16).strip()),
    ("word " * 15 + "seventy tail", ("word " * 15).strip()),
    ("y" * 95, "y" * 80),
    ("the " + "z" * 80, "z" * 80),
    ("\u00a0caf\u00e9\u00a0", "caf\u00e9"),
]
ARTICLE, MARKS = re.compile(r"(?:a|an|the)\s", re.I), tuple(".,;:)")


def test_clean_phrase_by_hand(spark):
    assert one(spark, X.clean_phrase, *[(t,) for t, _ in PHRASES]) == [p for _, p in PHRASES]


words = st.text(alphabet="ab THEn.,;:)\t \u00e9", max_size=120)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(words, min_size=1, max_size=20))
def test_clean_phrase_always(spark, texts):
    for t, p in zip(texts, one(spark, X.clean_phrase, *[(t,) for t in texts]), strict=True):
        assert p == p.strip() and p in t and len(p) <= 80
        if p.endswith(MARKS):
            # a mark at the end stays only before white space and further marks, which went
            assert len(t.strip()) > 80 or re.search(re.escape(p) + r"\s+[.,;:)]+\s*$", t)
        if p and len(t.strip()) <= 80:
            # nothing but an article in front, and marks behind, went away
            body = t.strip()
            bodies = [body, *([body.split(maxsplit=1)[-1]] if ARTICLE.match(body) else [])]
            assert any(x.startswith(p) and set(x[len(p) :]) <= set(".,;:) \t") for x in bodies)


SENTENCES = [
    ("One. Two! Three?", [("One", 0), ("Two!", 5), ("Three?", 10)]),
    ("No end", [("No end", 0)]),
    ("a\nb", [("a", 0), ("b", 2)]),
    ('He said "go." Then left.', [('He said "go', 0), ("Then left", 14)]),
    ("Dots... more", [("Dots", 0), ("more", 8)]),
    ("v1.5 is out. 3.0 is not", [("v1.5 is out", 0), ("3.0 is not", 13)]),
    ("same. same. same", [("same", 0), ("same", 6), ("same", 12)]),
    ("", []),
    (" . . ", []),
    ("What?! Yes", [("What?!", 0), ("Yes", 7)]),
    ("one.two", [("one.two", 0)]),
]


def test_sentences_by_hand(spark):
    got = one(spark, X.sentences, *[(t,) for t, _ in SENTENCES])
    assert [[tuple(s) for s in g] for g in got] == [s for _, s in SENTENCES]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abC .!?\n\"'", max_size=60), min_size=1, max_size=20))
def test_sentences_always(spark, texts):
    for t, found in zip(texts, one(spark, X.sentences, *[(t,) for t in texts]), strict=True):
        at = 0
        for sentence, start in found:
            assert t[start : start + len(sentence)] == sentence and start >= at and sentence and not sentence[0].isspace() and not sentence.endswith(".") and "\n" not in sentence
            at = start + len(sentence)


def test_sentences_are_looked_for_in_their_own_pieces(spark):
    """The whole text is used once; a sentence that stands earlier, in what was cut away, is found there; runs of sentences, and line ends between them, are joined."""
    df = spark.createDataFrame([("",)], "text string")
    plan = next(line for line in _optimized(df.select(X.sentences(F.col("text")).alias("s"))).split("\n") if "split(" in line)
    assert len(re.findall(r"\btext#", plan)) == 1
    odd = ['abc." "', 'abc." " " "', ". \n.\n. a\n\n\n.5 b", "end \n next .\n'", "\n\n"]
    found = [[("abc", 0), ('"', 4)], [("abc", 0), ('" " "', 4)], [("a", 7), (".5 b", 11)], [("end ", 0), ("next ", 6), ("'", 13)], []]
    assert [[tuple(s) for s in g] for g in one(spark, X.sentences, *[(t,) for t in odd])] == found
    for n in (X.RUN - 1, X.RUN, X.RUN + 1, 3 * X.RUN, 1000):
        for gap in ("\n", ". ", '." ', "!\n\n"):
            text, mark = gap.join(f"S{i}" for i in range(n)), gap[0].strip(".\n")
            [got] = one(spark, X.sentences, (text,))
            assert [tuple(s) for s in got] == [(f"S{i}" + mark * (i < n - 1), text.index(f"S{i}{gap}" if i < n - 1 else f"S{i}")) for i in range(n)]
    assert one(spark, X.sentences, (None,)) == [None]


def test_folding_of_every_code_point(spark):
    """As the standard library folds it, alone and between letters."""
    codes = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x110000))]
    texts = ["|".join(codes[i : i + 2000]) for i in range(0, len(codes), 2000)]
    want = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert one(spark, X.fold_unicode, *[(t,) for t in texts]) == want
    assert one(spark, X.fold_unicode, (None,), ("",)) == [None, ""]


TITLES = [
    "Loud noise causes stress in birds",
    "Birds are driven by hunger",
    "Sleep does not cause anything",
    "Tea never leads to sorrow",
    "Tea never improves mood",
    "No link between tea and sorrow",
    "Study shows that tea reduces stress",
    "Video: tea causes joy",
    "10 facts about tea that causes joy",
    "Fever due to infection",
    "Tea causes tea",
    "the causes the.",
    "Nothing here",
    "",
    "X causes Y",
    "A" * 90 + " causes " + "b c " * 40,
]


#: The pair of each title. Causes keep what stands before the verb; a phrase that is its article only is none.
PAIRS = [
    ("Loud noise", "stress in birds", "regex"),
    ("hunger", "Birds", "regex"),
    ("Sleep", "anything", "negation"),
    ("Tea never", "sorrow", "regex"),
    ("Tea never", "mood", "regex"),
    ("tea", "sorrow", "negation"),
    ("Study shows that tea", "stress", "regex"),
    ("Video: tea", "joy", "regex"),
    ("10 facts about tea that", "joy", "regex"),
    ("infection", "Fever", "regex"),
    ("Tea", "tea", "regex"),
    None,
    None,
    None,
    ("X", "Y", "regex"),
    ("A" * 80, ("b c " * 20).strip(), "regex"),
]


@pytest.mark.parametrize("study_first", [False, True])
def test_pairs(spark, study_first):
    got = one(spark, lambda c: steps.pair(c, study_first), *[(t,) for t in TITLES])
    # with reports first, what the study shows is the cause
    want = [("tea", *p[1:]) if study_first and p and p[0].startswith("Study") else p for p in PAIRS]
    assert [None if g is None else tuple(g) for g in got] == want


def test_detection(spark):
    def model(t):
        return not any(re.search(p, t, re.I) for p in patterns.EXCLUDED) and any(re.search(p, t, re.I) for p in patterns.EXPLICIT + patterns.IMPLICIT)

    assert one(spark, steps.is_causal, *[(t,) for t in TITLES]) == [model(t) for t in TITLES]
    assert one(spark, steps.is_causal, (None,)) == [False]


def test_small_expressions(spark):
    assert one(spark, X.normalize, ("  Crème   Brûlée\t№5 ",)) == ["creme brulee no5"]
    assert one(spark, X.clean_generated, ("«Rise of tea»\nmore", "f"), ('"Rise."', "f"), ("  ", "f")) == ["Rise of tea»", "Rise", "f"]
    assert one(spark, lambda t: X.mark_pair(t, F.lit(4), F.lit(6), F.lit(0), F.lit(2)), ("ab cd ef",)) == ["<e1>ab</e1> c<e0>d </e0>ef"]
    assert one(spark, lambda t, p: X.find(t, p), ("Big TEA", "tea"), ("x", "y"))[1] is None
    assert one(spark, lambda t: X.prompt("T {text} S {span}", t, F.lit("{text}")), ("a",)) == ["T a S {text}"]
    assert one(spark, X.wrap, ("aaaa bbbb cccccccccccccccccccc dd",)) == [["aaaa bbbb", "cccccccccccccccccccc", "dd"]]


def test_analyze(spark):
    docs = spark.createDataFrame([(1, "Tea causes joy. Joy leads to sleep!\nTea does not cause harm"), (2, "  "), (3, None)], "doc_id long, text string")
    events, relations = analyze.analyze(docs)
    assert [(r["index"], r.span_text, r.start, r.end) for r in events.orderBy("index").collect()] == [(0, "Tea", 0, 3), (1, "joy", 11, 14), (2, "sleep!", 29, 35), (3, "harm", 55, 59)]
    assert [(r.cause_event_index, r.effect_event_index, r.relation_type, r.p_causal) for r in relations.orderBy("sentence_index").collect()] == [(0, 1, "causal", 1.0), (1, 2, "causal", 1.0), (0, 3, "countercausal", 0.0)]
    assert analyze.response(docs).count() == 3


def test_first_places_are_those_of_find():
    r = random.Random(1)
    for _ in range(100):
        t = "".join(r.choices("abcé\U0001f600 ", k=r.randint(1, 300)))
        some = [t[i : i + r.randint(1, 9)] for i in r.choices(range(len(t)), k=20)] + ["zz", "", t + "x"]
        assert analyze.first_places(t, some) == [t.find(p) for p in some]


def test_analysis_of_a_long_document(spark, monkeypatch):
    lines = [f"Stress {i % 700} causes Pain {i % 90}" + ("." if i % 3 else " . ") for i in range(2000)]
    lines.insert(0, "the PAIN 7 was seen. STRESS 44 too")
    text = "\n".join(lines)
    asked = []
    monkeypatch.setattr(steps, "pair", lambda c, pair=steps.pair: asked.append(1) or pair(c))
    docs = spark.createDataFrame([(1, text), (2, "tea causes joy"), (3, " \n"), (None, "milk causes sleep")], "doc_id long, text string")
    events, relations = analyze.analyze(docs)
    got = {r.span_text.lower(): r for r in events.where("doc_id = 1").collect()}
    low = text.lower()
    assert len(got) == 790 and len(asked) == 1
    for name, r in got.items():
        at = low.find(name)
        assert r.description == text[at : at + len(name)] and text[r.start : r.end].lower() == name
    assert got["pain 7"].description == "PAIN 7" and got["stress 44"].description == "STRESS 44"
    assert got["stress 0"]["index"] == 0 and got["pain 0"]["index"] == 1
    assert sorted(r.sentence_index for r in relations.where("doc_id = 1").collect()) == list(range(2, 2002))
    assert {r.description for r in events.where("doc_id = 2 or doc_id is null").collect()} == {"tea", "joy", "milk", "sleep"}
    # lines are dealt to tasks: none has a document for itself
    plan = events._jdf.queryExecution().analyzed().toString()
    assert not re.search(r"(?<!\w)_text#", plan)


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_runs_of_words_need_no_join(spark):
    from causeway import fixtures

    texts, tokens, some, spans = fixtures.parsed(spark, "/root/testdata/sf0.001")
    for df in (tokens, some, spans):
        assert _optimized(df).count("Join ") == _optimized(texts).count("Join ")


def test_extraction_matches_a_title_once(spark):
    titles = spark.range(4).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("tea causes joy "), F.col("id").cast("string")).alias("title"))
    assert sum("regexp_extract" in line for line in _optimized(steps.extract(titles)).split("\n")) == 1


def test_titles_are_filtered_by_the_tasks_they_are_dealt_to(spark):
    """A filter of many patterns stays above the exchange, not in the few tasks that read the orders."""
    from causeway import fixtures

    plan = _optimized(steps.detect(fixtures.titles(spark, "/root/testdata/sf0.001")))
    assert plan.index("RLIKE") < plan.index("RepartitionByExpression") and plan.count("RLIKE") == len([line for line in plan.split("\n") if "RLIKE" in line]) * 2


def test_first_texts_need_no_sort_of_all_events(spark):
    rows = [(1, "a", "b", "A", "B"), (2, "b", "a", "B2", "A2"), (3, None, "c", None, "C"), (4, "c", "c", "C1", "C2"), (0, "z", "z", "Z1", "Z0")]
    relations = spark.createDataFrame(rows, "id long, cause_norm string, effect_norm string, cause_text string, effect_text string").withColumns({"cause_canonical": F.lit(""), "effect_canonical": F.lit("")})
    unique = steps.unique_events(relations)
    # only the relations that some norm was in first reach the sort
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and plan.rindex("SortAggregate") < plan.index("Join")
    assert {tuple(r) for r in unique.collect()} == {("a", "A", 1), ("b", "B", 1), ("c", "C", 3), ("z", "Z1", 0), (None, None, 3)}


def _odd_titles(spark):
    """Short and long titles, one of no text, one that comes twice and two of one document."""
    texts = ["tea causes joy and rest", "", " ", "a  b", None, "one", "red steel leads to more demand in all of the nine towns of the north", "tea causes joy and rest today"]
    return spark.createDataFrame([(str(i % 7), t) for i, t in enumerate(texts)] + [("6", texts[6]), ("8", "x " * 200)], "id string, title string")


@pytest.mark.parametrize("odd", [False, True])
def test_enclosing_shuffles_no_short_text(spark, monkeypatch, odd):
    from causeway import fixtures
    from causeway.operators import phrases

    if odd:
        monkeypatch.setattr(fixtures, "titles", lambda spark, _: _odd_titles(spark))
    _, _, some, spans = fixtures.parsed(spark, "/root/testdata/sf0.001")
    rows, (_, _, more, others) = fixtures.parsed_texts(spark, "/root/testdata/sf0.001", 9)
    found = phrases.enclosing_in(rows)
    sorted_rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    both = sorted_rows(found.unionByName(phrases.enclosing(others, more)))
    assert both == sorted_rows(phrases.enclosing(spans, some)) and rows.count() and others.count()
    if not odd:
        titles = fixtures.titles(spark, "/root/testdata/sf0.001")
        exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert exchanges(found) == exchanges(titles)


@pytest.mark.parametrize("odd", [False, True])
def test_smallest_phrase_shuffles_no_short_text(spark, monkeypatch, odd):
    from causeway import fixtures
    from causeway.operators import phrases

    if odd:
        monkeypatch.setattr(fixtures, "titles", lambda spark, _: _odd_titles(spark))
    texts, tokens, some, spans = fixtures.parsed(spark, "/root/testdata/sf0.001")
    rows, (long, words, more, others) = fixtures.parsed_texts(spark, "/root/testdata/sf0.001", 9)
    found = phrases.smallest_phrase_in(rows)
    sorted_rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    both = sorted_rows(found.unionByName(phrases.smallest_phrase(others, more, words, long)))
    assert both == sorted_rows(phrases.smallest_phrase(spans, some, tokens, texts)) and found.count()
    if not odd:
        titles = fixtures.titles(spark, "/root/testdata/sf0.001")
        exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert exchanges(found) == exchanges(titles)


def test_reach_in_rows(spark):
    """Trees, a long chain, cycles, heads that are null or don't exist: as over tables, without a shuffle."""
    from causeway.operators import phrases

    r = random.Random(3)
    docs = [("chain", [0, *range(300)]), ("down", [*range(1, 300), 299]), ("ring", [1, 2, 0, 1, 3]), ("self", [0]), ("odd", [None, 7, -1, 0, 3]), ("none", []), (None, [0, 0])]
    docs += [(f"d{k}", [r.randrange(12) for _ in range(12)]) for k in range(40)]
    rows = spark.createDataFrame(docs, "doc string, heads array<int>")
    tokens = rows.select("doc", F.posexplode("heads").alias("i", "head"))
    found = phrases.reach_in(rows)
    assert found.dtypes == phrases.reach(tokens).dtypes
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, phrases.reach(tokens).collect()), key=repr)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
