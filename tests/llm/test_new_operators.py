"""Substring dedup, manifest and spelling variants against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from causeway.llm import manifest, spelling, substrings

SPACE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


# Substring dedup ----------------------------------------------------------------------------------------------------


def plain_dedup(rows, window):
    """kept text of each (key, text), in order of key."""
    seen, out = {}, {}
    split = {k: (t or "").encode().split() for k, t in rows}
    for k in sorted(split):
        for i in range(len(split[k]) - window + 1):
            seen.setdefault(tuple(split[k][i : i + window]), (k, i))
    for k, words in split.items():
        gone = {j for i in range(len(words) - window + 1) if seen[tuple(words[i : i + window])] != (k, i) for j in range(i, i + window)}
        out[k] = (len(words), len(gone), b" ".join(w for j, w in enumerate(words) if j not in gone).decode())
    return out


def passages(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 3)))
    shared = [[word() for _ in range(r.choice((19, 20, 21, 45)))] for _ in range(4)]
    rows = []
    for k in range(n):
        text = []
        for _ in range(r.randint(0, 4)):
            text += [word() for _ in range(r.randint(0, 12))] + r.choice(shared)
            if r.random() < 0.3 and text:
                text[r.randrange(len(text))] = word()
        rows.append((k * 3, r.choice(SPACE).join(text)))
    rows += [(500, "x " * 70), (501, "x " * 50), (502, "a b c " * 30), (503, None), (504, ""), (505, " \n "), (506, rows[1][1]), (507, "a b " * 25)]
    return rows


@pytest.mark.parametrize("crowd", [512, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_against_brute_force(spark, seed, crowd):
    rows = passages(seed)
    df = frame(spark, [(k, t, "en", "s", 1) for k, t in rows]).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.deduplicate(df, crowd=crowd).collect()}
    assert got == plain_dedup(rows, 20)


def test_dedup_by_windows_alone(spark):
    """Passages of one anchor that no order of grams divides meet by their windows."""
    rows = passages(3)
    words = [(k, 0, i, [hash(w) for w in (t or "").split()[i : i + 25]]) for k, t in rows for i in range(0, max(0, len((t or "").split()) - 24), 5)]
    df = spark.createDataFrame(words, "id bigint, tie bigint, start bigint, words array<bigint>")
    first, want = {}, set()
    for k, tie, start, w in sorted(words):
        for i in range(6):
            first.setdefault(tuple(w[i : i + 20]), (k, tie, start + i))
    for k, tie, start, w in words:
        want |= {(k, tie, start + i, start + i + 20) for i in range(6) if first[tuple(w[i : i + 20])] != (k, tie, start + i)}
    assert {tuple(r) for r in substrings._window_spans(df, 20).collect()} == want


def test_dedup_edge_cases(spark, rows):
    long = " ".join(f"w{i}" for i in range(30))
    df = frame(spark, [(1, long, None, None, None), (1, long, None, None, None), (None, long, None, None, None), (2, "new " + long, None, None, None), (2, "other " + long, None, None, None)]).withColumnsRenamed({"lang": "id", "source": "tie", "n_chars": "words"})
    got = rows(substrings.deduplicate(df).select("doc_id", "n_words", "n_removed", "kept"))
    assert got == sorted([(1, 30, 30, ""), (1, 30, 30, ""), (None, 30, 0, long), (2, 31, 30, "new"), (2, 31, 30, "other")], key=repr)
    assert substrings.deduplicate(df.limit(0)).count() == 0
    very_long = frame(spark, [(1, "a b c d e f g " * 60_000, None, None, None), (2, "word " * 200_001, None, None, None)])
    assert {r.doc_id: r.n_removed for r in substrings.deduplicate(very_long).collect()} == {1: 419_993, 2: 200_000}
    with pytest.raises(ValueError):
        substrings.deduplicate(df, window=7)


def test_automaton_knows_every_run():
    r = random.Random(5)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(1, 12))) for _ in range(12)]
    a, at = substrings.Automaton(), 0
    where = {}
    for t in texts:
        ends = list(range(at, at + len(t)))
        a.add(t, ends)
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                where[t[i:j]] = min(where.get(t[i:j], 1 << 30), ends[j - 1])
        at += len(t)
    for q in texts + ["abababababab", "bbbbbbbb"]:
        found = dict(a.matches(q, 3))
        assert found == {i: where[q[i - 2 : i + 1]] for i in range(2, len(q)) if q[i - 2 : i + 1] in where}


# Manifest ------------------------------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """root, and for each leaf its proof as (place, run) level by level."""
    proofs, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            proofs[leaf].append((i % 16, run))
        at = [i // 16 for i in at]
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], proofs


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*[field(v) for v in (r[0], r[3], r[2], r[4], text)])
    lower = lambda t: None if t is None else t.encode().lower().decode()
    groups = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, lower(r[1])) if hit else None))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, above = plain_tree([trees[s][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for (has, key, own, other), proof in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            fold, beside = other or own, ""
            for place, run in proof + above[g]:
                beside += "".join(run[:place] + run[place + 1 :])
                fold = H(*run[:place], fold, *run[place + 1 :])
            out.append((key if has else None, own, trees[s][0], root, hashlib.sha256(beside.encode()).hexdigest(), fold, fold == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{"a": 300, "b": 1, None: 17, "c": 16, "é": 2}, {"only": 33}, {"only": 1}, {f"s{i:02}": 1 + i % 3 for i in range(40)}])
def test_manifest_against_brute_force(spark, rows, sizes):
    made, key = [], 0
    for s, n in sizes.items():
        for i in range(n):
            key += 1
            made.append((key if i % 50 != 7 else None, None if i % 9 == 4 else f"Text É {key}" if i % 2 else "", None if i % 3 else "EN", s, key if i % 4 else None))
    made += made[:2]
    df = frame(spark, made).repartition(3)
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    out = manifest.manifest(df.withColumns({"leaf": F.lit(1), "tree": F.lit(1), "order": F.lit(1), "_x": F.lit(0)}), ["doc_id", "source", "lang", "n_chars", "text"], changed={"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}, when=hit)
    got = rows(out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("p"), "folded", "verified"))
    assert got == plain_manifest(made)


def test_empty_manifest(spark):
    assert manifest.manifest(frame(spark, []), ["doc_id", "text"]).collect() == []


def test_fragments_add_up_in_any_order():
    leaves = [H(str(i)) for i in range(1000)]
    for seed in range(3):
        r = random.Random(seed)
        order = list(range(1000))
        r.shuffle(order)
        parts = [manifest.Forest(2) for _ in range(7)]
        for i in order:
            parts[r.randrange(7)].add(0, 1000, 0, i, leaves[i])
        whole = parts[0]
        for p in parts[1:]:
            for (tree, level, run), kids in p.open.items():
                for i, h in kids.items():
                    whole.add(tree, p.sizes[tree], level, run * 16 + i, h)
        whole.add(1, 1, 0, 0, "x")
        assert not whole.open
        assert whole.runs[-1] == (manifest.ROOT, 1, 0, 0, [H(plain_tree(leaves)[0], "x")])


# Spelling variants -----------------------------------------------------------------------------------------------------


def plain_words(rows):
    import re

    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=repr)


def misspelt(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(6, 10))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]
    words = []
    for i, w in enumerate(base):
        words += [w] * (1 + i * i)
        for _ in range(6):
            at, v = r.randrange(len(w)), w
            for _ in range(r.randint(1, 2)):
                v = v[:at] + r.choice(("", r.choice("abcé"), v[at : at + 1] + r.choice("abcé"))) + v[at + 1 :]
            words += [v] * r.choice((1, 2, 3, 20))
    words += ["xchaindé"] * 3 + ["chaindé"] * 60 + ["chaindb"] * 900
    r.shuffle(words)
    rows = [(i, " ".join(w.upper() if r.random() < 0.1 and "é" not in w else w for w in words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    return rows + [(None, words[0] + "-" + words[1] * 2), (900, None), (901, ""), (902, "ÿÿÿÿÿÿÿ×÷ ÿÿÿÿÿÿÿ×÷, ÿÿÿÿÿÿÿ×÷")] + rows[:2]


@pytest.mark.parametrize("cell", [spelling.CELL, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_variants_against_brute_force(spark, rows, seed, cell):
    made = misspelt(seed)
    df = frame(spark, [(k, t, "en", "s", 1) for k, t in made]).withColumnsRenamed({"lang": "word", "source": "n", "n_chars": "form"}).repartition(3)
    out = spelling.variants(df, cell=cell).select("word", "form", "root", "n", "n_near", "form_n")
    want = plain_variants(made)
    assert rows(out) == want and any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want)


def test_no_words(spark):
    assert spelling.variants(frame(spark, [])).count() == 0 and spelling.variants(frame(spark, [(1, None, None, None, None), (2, "short", None, None, None)])).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    r = random.Random(7)
    text = "".join(r.choice("abcÀÿ .\n") for _ in range(4000))
    whole = spelling.runs_of(text)
    monkeypatch.setattr(spelling, "CHUNK", 50)
    assert whole and spelling.runs_of(text) == whole


def test_numbers_of_words():
    r = random.Random(8)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(80)})
    a = spelling.Words(words)
    assert [a._walk(a.root, 0, w)[1] for w in words] == list(range(len(words))) and a.size[a.root] == len(words)
    for w in words:
        half = len(w) // 2
        for longer in (False, True):
            want = {v for v in words if is_near(w, v) and len(v) == len(w) + longer and v[:half] == w[:half]}
            assert sorted(words[i] for i in a.near(w, half, longer)) == sorted(want)
