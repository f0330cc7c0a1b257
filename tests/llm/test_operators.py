"""The ten operators against brute force, round trips and held-out labels; nulls, empty tables, repeated rows, clashing columns, long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from causeway.llm import bpe, common, fingerprints, licenses, lm_scoring, media, mixing, pii, quality, simhash, url_filter

WORDS = "tea joy mit license the apache general public of and a light wind stone".split()


def texts(n=60, seed=1):
    r = random.Random(seed)
    out = [None, "", " \n\t ", "one", "Ünï çödé ñ", "x" * 70_000, "a\n\nb\nc", "MIT License. the MIT  LICENSE", "General Public-License"]
    out += [" ".join(r.choices(WORDS, k=r.randint(1, 90))) + r.choice(["", "\n", ".\n\nlast"]) for _ in range(n)]
    return out + out[-6:] + [out[-1] + " more"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["s1", "s2", None, "s\u00fc"][i % 4], "extra") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, facts string")


@pytest.fixture(scope="module")
def table(docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs.repartition(3).write.mode("overwrite").parquet(f"{d}/documents.parquet")
    return d


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(b):
    return hashlib.sha256(b).hexdigest()


def empty_table(docs, d):
    docs.limit(0).write.mode("overwrite").parquet(f"{d}/documents.parquet")
    return d


# 1


def test_fingerprints(spark, docs, table):
    got, rows = by_id(fingerprints.op1(spark, table)), [(r.doc_id, r.text or "") for r in docs.orderBy(F.desc("doc_id")).collect()]
    for i, (k, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 3
        assert got[k].edited_sha256 == sha((t[: len(t) - cut] + following[:cut]).encode()) and got[k].n_chars == len(t)
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
        assert (got[k].near_next == 1) == (t == following)
    prints = {}
    for k, t in rows:
        assert prints.setdefault(t, got[k].fingerprint) == got[k].fingerprint
    assert len(set(prints.values())) == len(prints)


def test_fingerprint_differences(spark):
    df = spark.createDataFrame([("a\nb\n\nc", "a\nx\n\nc\nd"), ("a", "a"), (None, ""), ("a\n\nb", "a")], "u string, v string")
    got = df.select(fingerprints.differing(fingerprints.tree(F.col("u")), fingerprints.tree(F.col("v"))).alias("d")).collect()
    assert [[tuple(x) for x in r.d] for r in got] == [[(0, 1), (1, 1)], [], [], [(1, 0)]]


def test_separators_and_lengths(spark):
    """Blank lines count; texts on either side of any length are cut by one rule; an insertion moves no later run."""
    words = " ".join(f"lake w{i} stone" for i in range(60))
    df = spark.createDataFrame([("a\n \nb", "a\n\nb"), ("x" * 95, "x" * 95 + "y"), (words, "new " + words)], "u string, v string")
    u, v = fingerprints.tree(F.col("u")), fingerprints.tree(F.col("v"))
    got = df.select((u["root"] == v["root"]).alias("same"), fingerprints.likeness(u, v).alias("near")).collect()
    assert not any(r.same for r in got) and got[1].near > 0.3 and got[2].near > 0.95


def drawn(alphabet, n, seed):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("alphabet", [[chr(c) for c in range(0x4E00, 0x9FA5)], "абвгдежзийклмнопрстуфхцчшщъыьэюя   ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ETAOINSHRDLU   "])
def test_insertions_move_no_other_run(spark, alphabet):
    """In long lines of any script and case, one character more near the start leaves almost all runs as they were."""
    text = drawn(alphabet, 1500, 3)
    u, v = fingerprints.tree(F.col("u")), fingerprints.tree(F.col("v"))
    assert spark.createDataFrame([(text, text[:5] + alphabet[7] + text[5:])], "u string, v string").select(fingerprints.likeness(u, v).alias("n")).first().n >= 0.95


def test_likeness_against_all_runs(spark):
    """The walk into differing branches finds what a comparison of all runs with their counts finds; unequal texts stay below 1."""
    r = random.Random(5)
    lines = [drawn("abc de", r.randrange(0, 40), i) for i in range(12)] + ["", " "]
    pairs = [tuple("\n".join(r.choice(lines) for _ in range(r.randrange(0, 30))) for _ in range(2)) for _ in range(60)]
    pairs += [("a\nb", "b\na"), ("a " * 50, "a " * 5000), ("", ""), (None, ""), ("", "x")]
    u, v = fingerprints.tree(F.col("u")), fingerprints.tree(F.col("v"))

    def runs(text):
        out = Counter()
        for line in (line for section in re.split(r"\n[ \t\r]*\n", text or "") for line in section.split("\n")):
            run = b""
            for byte in line.encode():
                run += bytes([byte])
                if len(run) > 1 and run[-1] % 16 == (4 * (run[-2] % 16) + 8) % 16:
                    out[run] += 1
                    run = b""
            if run:
                out[run] += 1
        return out

    for (a, b), row in zip(pairs, spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, u string, v string").select("i", fingerprints.likeness(u, v).alias("n")).orderBy("i").collect()):
        x, y = runs(a), runs(b)
        same = (a or "") == (b or "")
        assert row.n == pytest.approx(1.0 if same else 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()) + 2)) and (row.n == 1.0) == same


def test_edges_of_ranges(spark, tmp_path):
    rows = [(None, "n"), (5, "five"), (5, "fivefive"), (9, "nine nine"), (-3, "minus"), (None, "null id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert fingerprints.op1(spark, str(tmp_path)).count() == 6
    one = fingerprints.edited(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited == "abcdab"


# 2


def license_model(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    at, labels = [], set()
    for label, phrase, base in licenses.TEMPLATES:
        p = phrase.split()
        if base:
            found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += found
            labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(spark, docs, table):
    got = by_id(licenses.op2(spark, table))
    for r in docs.collect():
        x = got[r.doc_id]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == license_model(r.text)
        assert set(x.base_labels.split(",")) - {""} <= set(x.labels.split(",")) and 0 <= x.score <= 1


def test_license_blocks_by_brute_force(spark):
    r, templates = random.Random(3), (("p", "a b c d e", False), ("q", "c f g h i j k l m n", False), ("z", "a b", True))
    rows = [(i, " ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(0, 120)))) for i in range(80)]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates, stride=8))
    for i, t in rows:
        w, want, reach = t.split(), set(), 9
        for b in range(0, len(w), 8):
            block = set(w[b : b + 8 + reach])
            for label, phrase, base in templates:
                p = set(phrase.split())
                if not base and len(block & p) >= 0.8 * len(p):
                    want.add((b, label, len(block & p) / len(p)))
        want |= {(k, "z", 1.0) for k in range(len(w) - 1) if w[k : k + 2] == ["a", "b"]}
        assert {(m.start, m.label, m.score) for m in got[i].matches} == want


# 3


def test_scores_tell_target_from_rest(spark):
    rows = [(i, "calm sea blue sky " * 5 if i % 2 else "$$ buy now !! cheap " * 5, i % 2 == 1) for i in range(40)] + [(40, None, None), (41, "", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, aimed boolean")
    got = by_id(lm_scoring.score(df, lm_scoring.fit(df)))
    assert max(got[i].lm.difference for i in range(1, 40, 2)) < min(got[i].lm.difference for i in range(0, 40, 2))
    assert got[40].lm.n_tokens == 0 and got[41].lm.difference == 0.0
    assert lm_scoring.score(df.limit(0), lm_scoring.fit(df.limit(0))).count() == 0
    assert {x.lm.difference for x in lm_scoring.score(df, lm_scoring.fit(df.withColumn("aimed", F.lit(False)))).collect()} == {0.0}


def lm_model(rows):
    """Counts of n-grams and histories as plain dictionaries; differences(text, aimed, own) of every byte."""
    n, grams, pasts, pairs = lm_scoring.ORDER, [{}, {}], [{}, {}], [{}, {}]
    cut = lambda t: [d[i : i + n] for d in [b"\0" * (n - 1) + (t or "").encode().lower()] for i in range(len(d) - n + 1)]
    add = lambda m, k, by=1: m.__setitem__(k, m.get(k, 0) + by)
    for _, t, aimed in rows:
        for k in (0, 1) if aimed else (1,):
            for g in cut(t):
                add(grams[k], g)
                add(pasts[k], g[:-1])
                add(pairs[k], g[-2:])
    totals = [sum(m.values()) for m in grams]
    weight = [1.0, totals[0] / totals[1]]

    def differences(t, aimed, own):
        mine, past = {}, {}
        for g in cut(t) if own else []:
            add(mine, g)
            add(past, g[:-1])
        out = []
        for g in cut(t):
            p = []
            for k in (0, 1):
                less = own and (aimed or k == 1)
                seen = weight[k] * (grams[k].get(g, 0) - less * mine.get(g, 0))
                before = weight[k] * (pasts[k].get(g[:-1], 0) - less * past.get(g[:-1], 0))
                one = (weight[k] * pairs[k].get(g[-2:], 0) + 1) / (weight[k] * sum(v for x, v in pairs[k].items() if x[0] == g[-2]) + 256)
                p.append((seen + lm_scoring.MASS * one) / (before + lm_scoring.MASS))
            out.append(np.log(p[1]) - np.log(p[0]))
        return out

    return differences


@pytest.mark.parametrize("hot,cut", [(1 << 19, 1 << 21), (200, 50)])
def test_losses_by_brute_force(spark, monkeypatch, hot, cut):
    """Losses of every byte, of the fitted documents without their own counts and of others; few frequent n-grams and short slices give the same."""
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    monkeypatch.setattr(lm_scoring, "SLICE", cut)
    r = random.Random(12)
    made = [" ".join(r.choice(["the", "of", f"W{r.randint(0, 900)}", "\u00c9t\u00e9"]) for _ in range(r.randint(1, 40))) for _ in range(60)]
    rows = [(i, t, i % 3 == 0) for i, t in enumerate(made + made[:2] + [None, "", " ", "a", "the \u00c9 the", "x" * 3000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, aimed boolean").withColumn("_id", F.lit("mine")).withColumn("h", F.lit(1))
    model, models = lm_model(rows), lm_scoring.fit(df.repartition(3))
    other = [(9000, "the of the unseen words", None), (9001, made[5][:200] + " of new", None)]
    for part, own in ((rows, True), (other, False)):
        given = df if own else spark.createDataFrame(part, "doc_id long, text string, aimed boolean").withColumn("_id", F.lit("mine")).withColumn("h", F.lit(1))
        got = by_id(lm_scoring.score(given, models, own=own))
        assert len(got) == len(part) and {x["_id"] for x in got.values()} == {"mine"}
        for k, t, aimed in part:
            want = model(t, aimed, own)
            assert got[k].lm.n_tokens == len(want)
            assert np.isclose(got[k].lm.difference, np.mean(want) if want else 0.0, atol=1e-8) and np.isclose(got[k].lm.worst, max(want, default=0.0), atol=1e-8)


# 4


def url_model(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def test_url_rules(spark, rows):
    urls = ["http://A.Example.com/en/7x?q=1", "https://b.com/en/", "https://xcom/en/1", "ftp://example.net/de/8#a", "x.org/es/", None, "a://org/es/://z", "http://m.example.net?/de/", "://k.net/de/1", ""]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit(None).cast("string"))).collect()}
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path) == url_model(u)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (got[i].host == h or got[i].host.endswith("." + h)) and got[i].path.startswith(p)]
        assert got[i].rule == (max(fits)[1] if fits else None)
        assert not fits or got[i].verdict == max(fits)[2]


def test_decisions_follow_links(spark):
    page = lambda i, u, h="": (i, u, h)
    links = [page(1, "http://a.org/es/1", "<link rel='canonical' href='http://b.dev/x'>"), page(2, "http://b.dev/x"), page(3, "https://www.b.dev/x/?utm_source=z"), page(4, "http://c.dev/1", "<meta http-equiv=refresh content='0;url=/2'>"), page(5, "http://c.dev/2", '<LINK href="http://example.com/en/7" rel=canonical>'), page(6, "http://d.dev/", None), page(7, "http://b.dev/y")]
    df = spark.createDataFrame(links, "page_id long, url string, html string")
    said = {r.page_id: r.verdict for r in url_filter.judge(df).collect()}
    assert said == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    more = spark.createDataFrame([("http://b.dev/x", "http://example.com/en/7"), (None, "x")], "url string, target string")
    assert {r.page_id: r.verdict for r in url_filter.judge(df, redirects=more).collect()}[2] == "allow"
    assert url_filter.judge(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(330)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2060)] + [(None, 1), (7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = {x.node: x.component for x in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in up}


# 5


def test_quality(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choices(WORDS, k=60)) + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in r.choices(WORDS, k=60))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([x[:2] for x in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = by_id(quality.score(docs, model))
    held = {x.doc_id for x in docs.where(quality.fold() == 0).collect()}
    assert held == {i for i in [*range(300), 900, 901] if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all((got[i].score >= 0.3) == (q == 1) for i, _, q in rows) and all(0 <= x.score <= 1 for x in got.values())
    x = docs.select("doc_id", quality.statistics().alias("s")).select("doc_id", "s.*").toPandas()
    assert np.allclose(model.predict({k: x[k].to_numpy(float) for k in quality.NAMES}), [got[i].score for i in x["doc_id"]])
    one = quality.fit({k: np.zeros(4) for k in quality.NAMES}, np.ones(4))
    assert one.predict({k: np.zeros(1) for k in quality.NAMES})[0] > 0.9
    assert quality.train(docs, labels.limit(0)).rules == ()


# 6


def print_model(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) > len(s))


@pytest.mark.parametrize("crowd", [256, 1])
def test_simhash(spark, docs, crowd):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = {k: print_model(t) for k, t in rows}
    up = {k: k for k in prints}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                up[max(root(a), root(b))] = min(root(a), root(b))
    got = by_id(simhash.groups(docs, crowd=crowd).withColumnRenamed("key", "doc_id"))
    assert {k: x.fp & (2**64 - 1) for k, x in got.items()} == prints
    assert {k: x.component for k, x in got.items()} == {k: root(k) for k in prints}


def test_close_prints_are_found(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << i for i in r.sample(range(64), k)) for b in base for k in (1, 2, 3)]
    signed = [x - (1 << 64) if x >> 63 else x for x in {*base, *near}]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    assert {tuple(x) for x in got.collect()} == want


def test_near_copies(spark):
    r = random.Random(6)
    rows = []
    for g in range(12):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(3, 200))]
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = f"v{r.randint(0, 5000)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, " "), (None, "no key"), (None, "no key"), (None, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for k, t in rows:
        if k is not None:
            w = (t or "").split()
            sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
    up = {k: k for k in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    got = by_id(simhash.near_groups(df))
    assert {k: x.component for k, x in got.items()} == {k: root(k) for k in sets}
    kept = simhash.deduplicate(df.unionByName(df.limit(3)))
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted({root(k) for k in sets})
    assert sum(x.doc_id is None for x in kept.collect()) == 2
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_near_copies_that_share_a_template(spark):
    """Pairs at 0.84 among 400 texts at 0.796, just below the bound: each pair is found, and nothing else."""
    part = lambda name, n: [f"{name}_{i}" for i in range(n)]
    rows = [(i, " ".join(part("t", 266) + part(f"p{i // 2}", 8) + part(f"o{i}", 26))) for i in range(400)]
    got = by_id(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert {k: x.component for k, x in got.items()} == {i: i // 2 * 2 for i in range(400)}


def test_large_groups_make_few_pairs(spark):
    """Each class of a large bucket is compared with its middle only, which is the one that meets most others."""
    rows = [(i, [1000, i]) for i in range(300)] + [(300, [1000, 7])]
    pairs = {(x.a, x.b) for x in simhash._band_pairs(spark.createDataFrame(rows, "node long, bands array<bigint>")).collect()}
    assert len(pairs) == 300 and {b for _, b in pairs} | {a for a, _ in pairs} == set(range(301)) and {a for a, _ in pairs} <= {7, 300}


# 7


def test_personal_data(spark):
    r = random.Random(8)
    alphabet = ["a", "Z", "9", "1", "4", ".", "@", "-", " ", "+", "%", "(", ")", "\n", "é", "1.2.3.4", "4111 1111 1111 1111", "a@b.co", "+1 (212) 555-0100", "🙂"]
    rows = [(i, "".join(r.choices(alphabet, k=r.randint(0, 14)))) for i in range(400)] + [(900, None), (901, ""), (902, "9" * 30_000), (903, "a" * 50_000 + "@"), (904, "0" * 5000 + ".1.2.3")]
    got = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string")))
    for k, t in rows:
        want = []
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t or "") if k < 900 else []:
            want.append((m.start(), 0, m.end()))
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t or "") if k != 902 else []:
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                want.append((m.start(), 1, m.end()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
                want.append((m.start(), 2, m.end()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t or ""):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                want.append((m.start(), 3, m.end()))
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in got[k].spans if s.base] == sorted(want), t
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("token", ["a1B2" * 32, "a1B2" * 33, "Zq7-" * 5000, "x" * 100 + "9"])
def test_long_tokens_are_candidates(token):
    text = f"key = {token}, and more"
    assert pii.candidates(text, *pii.base_spans(text)) == [(4, 6, 6 + len(token))]
    assert pii.votes(text, 4, 6, 6 + len(token))[0] == pii.votes("key = " + "a1B2" * 8, 4, 6, 38)[0]
    assert pii.candidates("x" * 500, [], []) == [] and pii.candidates("no 9 " + "x" * 500, [], []) == []


def test_redaction(spark):
    rows = [(1, "mail é a@b.co now", 7), (2, None, 7), (3, "no data", 7), (4, 'token = "0123456789abcdef0123456789abcdef01234567" +1 (212) 555-0100', 7)] + [(10 + i, f'token = "{hashlib.sha1(bytes([i])).hexdigest()}"', 7) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = by_id(pii.redact(df))
    assert got[1].text == "mail é [email] now" and got[2].text is None and got[3].text == "no data" and got[1].spans == 7
    assert got[4].text == 'token = "[secret]" [phone]'


def test_reliabilities_find_the_good_labeler():
    r, counts = random.Random(1), {}
    for _ in range(3000):
        truth = r.random() < 0.5
        said = tuple((pii.YES if (truth == (r.random() < a)) else pii.NO) for a in (0.95, 0.9, 0.85, 0.6, 0.55, 0.9))
        p = pii.pattern(4, said)
        counts[p] = counts.get(p, 0) + 1
    chance, says = pii.reliabilities(counts)
    assert says[0, 0] > says[3, 0] and says[0, 1] < says[3, 1] and says[0, 0] > 0.9
    assert pii.span_classifier(counts)[pii.pattern(4, (pii.YES,) * 6)] > 0.9 and pii.span_classifier({}) == {}


# 8


def test_bpe(spark, docs, table):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = by_id(bpe.op8(spark, table))
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        x = got[r.doc_id]
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode()))
    own, rnd = bpe.Codec(path, public.PATTERN), random.Random(0)
    for _ in range(2000):
        t = "".join(rnd.choices("abcdeth inon'sé \n\t1239.,!ñ\x1c\x0b\x85🙂", k=rnd.randint(0, 60)))
        assert own.encode(t).tolist() == enc.encode_ordinary(t) and own.decode(own.encode(t)) == t.encode()
    both = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit(1)), path, public.PATTERN), path, public.PATTERN)
    assert both.where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), path, public.PATTERN).first().decoded == b""


# 9


def test_media(spark, docs, table):
    got = by_id(media.op9(spark, table))
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data + b"\0" * ((-len(data)) % 64 if data else 64)
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        png = media.encode_png(payload)
        assert x.media_bytes == len(png) and x.media_sha256 == sha(png) and len(x.feature) == 16


def test_png_filters_and_damage():
    payload = bytes(np.random.default_rng(0).integers(0, 256, 64 * 9, dtype=np.uint8))
    for kind in range(5):
        png = media.encode_png(payload, kind)
        assert media.decode_png(png).tobytes() == payload
    for at in (3, 20, len(png) // 2, len(png) - 6):
        with pytest.raises(ValueError):
            media.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(png[:-4])
    a, b = np.tile(np.arange(64, dtype=np.uint8), (40, 1)), np.tile(np.arange(64, dtype=np.uint8), (41, 1))
    assert bin(int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).count("1") <= 6


# 10


def target_model(sizes):
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, list(names), 1.5 * sum(sizes.values())
    while free:
        each = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if each[s] > 2 * sizes[s]]
        if not over:
            return target | each
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free = [s for s in free if s not in over]
    return target


def test_mixing(spark, docs, table):
    rows = docs.collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
    totals = {}
    for r in rows:
        totals[r.source] = totals.get(r.source, 0) + size[r.doc_id]
    want, got, taken = target_model(totals), by_id(mixing.op10(spark, table)), {}
    for r in rows:
        x = got[r.doc_id]
        assert (x.size, x.source_size) == (size[r.doc_id], totals[r.source]) and abs(x.target - want[r.source]) < 1e-6
        assert x.taken <= 2 * x.size and (x.size == 0 or x.taken % x.size == 0)
        taken[r.source] = taken.get(r.source, 0) + x.taken
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 5 for s in want)
    again = by_id(mixing.op10(spark, table))
    assert all(again[k].taken == got[k].taken for k in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(x.taken // x.size for x in got.values() if x.size) + sum(1 for _ in mixed.where("length(trim(coalesce(text, ''))) = 0 or trim(text) rlike '^\\\\s*$'").collect())


def test_pivotal_keeps_sums(spark):
    """Counts are kept where sizes are the same, words where they differ, to less than one row."""
    rows = spark.createDataFrame([(p, 900, p * 10_000 + i, 1 if p % 2 else 1 + (i * 37) % 50, 0.1 + 0.2 * p) for p in range(4) for i in range(900)], "part int, n long, id long, size long, p double")
    got = mixing.pivotal(rows, group=64).join(rows.drop("n"), ["part", "id"]).groupBy("part").agg(F.sum(F.col("copy") * F.col("size")).alias("n"), F.sum(F.col("p") * F.col("size")).alias("t"), F.count("*").alias("m"), F.count_distinct("id").alias("d"), F.max("size").alias("s"), F.avg("copy").alias("c")).collect()
    for r in got:
        assert abs(r.n - r.t) < r.s + 1e-6 and r.m == r.d == 900 and abs(r.c - (0.1 + 0.2 * r.part)) < 0.06


@pytest.mark.parametrize("sizes", [(7, 2, 40), (5, 5, 4, 1), (1, 1, 1, 1, 90)])
@pytest.mark.parametrize("group", [2, 512])
def test_pairs_are_fair(spark, sizes, group):
    """Over many parts each row is taken as often as its probability says, whatever the sizes, in one group and over several levels."""
    n, p = len(sizes), 0.35
    rows = [(k, n, k * n + i, s, p) for k in range(3000) for i, s in enumerate(sizes)]
    got = mixing.pivotal(spark.createDataFrame(rows, "part long, n long, id long, size long, p double"), group=group).groupBy((F.col("id") % n).alias("i")).agg(F.avg("copy").alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == pytest.approx([p] * n, abs=0.04)


def test_targets_of_many_sources(spark):
    """Targets of 5,000 sources, most of them at their cap, equal the plain rounds; no row of them comes to the driver."""
    r = random.Random(2)
    sizes = {f"s{r.randrange(10**9)}é{i}": int(r.paretovariate(0.7)) - 1 for i in range(5000)} | {None: 10, "": 3}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, total long")).collect()
    want = target_model(sizes)
    assert len(got) == len(sizes) and all(x.target == pytest.approx(want[x.source], rel=1e-9) for x in got)


def test_mix_of_ties_repeats_and_hot_sources(spark, monkeypatch):
    """Null and hot sources, repeated rows, null ids and empty texts; the table of sources may also be shuffled. Extra columns stay."""
    rows = [(i, "w " * (1 + i % 5), "hot", i) for i in range(800)] + [(7, "a b c", None, 1)] * 3 + [(None, None, "x", 2), (None, "", "x", 2), (5000, "q r s t u", "y", 3)] + [(6000 + i, "k", "z", 4) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    first = mixing.plan(df).collect()
    monkeypatch.setattr(common, "SMALL", 1)
    monkeypatch.setattr(common, "hub_bound", lambda n: 100)
    again = mixing.plan(df).collect()
    assert sorted(map(tuple, first), key=repr) == sorted(map(tuple, again), key=repr) and len(first) == len(rows)
    for size, source in {(x.source_size, x.target) for x in first}:
        taken = sum(x.size * x.copies for x in first if x.source_size == size)
        assert abs(taken - source) < max(x.size for x in first if x.source_size == size) * 3 + 1e-6
    assert all(0 <= x.copies <= 2 for x in first) and mixing.mix(df).columns == df.columns


# Empty tables and batches


def test_empty_tables(spark, docs, tmp_path):
    d = empty_table(docs, str(tmp_path))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for f in (fingerprints.op1, licenses.op2, lm_scoring.op3, quality.op5, simhash.op6, pii.op7, media.op9, mixing.op10):
        assert f(spark, d).count() == 0


def test_exploded_fingerprints_are_never_broadcast(spark):
    prints = spark.range(3000).select(F.xxhash64("id").alias("fp")).unionByName(spark.createDataFrame([(1 << i,) for i in range(40)], "fp long")).groupBy("fp").agg(F.count("*")).select("fp")
    for crowd in (simhash.CROWD, 8):
        df = simhash.links(prints, crowd)
        pairs = {tuple(sorted(r)) for r in df.collect()}
        assert len(pairs) >= 39
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        for at in (m.start() for m in re.finditer("BroadcastExchange", plan)):
            line = plan[plan.rfind("\n", 0, at) + 1 : plan.find("\n", at)]
            depth, below = at - plan.rfind("\n", 0, at), plan[at:].split("\n")[1:]
            for b in below:
                if len(b) - len(b.lstrip(" :+-*()0123456789")) < depth - 2:
                    break
                assert "Generate explode" not in b, line
