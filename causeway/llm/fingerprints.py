"""Document fingerprints: Merkle trees over the paragraphs and sections of texts, and the likeness and differences of two trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A run, the finest branch of a tree, ends where a window of two bytes of UTF-8 says so: where the low halves a, b of the two give b = 4a + 8 (mod 16), both bytes in the run. That is one
#: place in ten to sixteen, whatever the script or case; nothing further away counts, so runs are as before soon after an insertion. A stretch without such a place, such as "abab", is one run.
_ENDS = "|".join(f"[{''.join(f'{a:X}' for a in range(k, 16, 4))}].{(4 * k + 8) % 16:X}" for k in range(4))
#: Over the hexadecimal digits of a text: a run, and what follows the last place.
RUNS = f"(?:..)*?.(?:{_ENDS})|(?:..)+"
#: Hexadecimal digits that a tree keeps of a run's hash; a paragraph's hash is made of whole ones.
SHORT = 6
#: A section ends at a blank line, a paragraph at a line end.
SECTION, PARAGRAPH = r"\n[ \t\r]*\n", r"\n"


def tree(text: Column) -> Column:
    """The Merkle tree of a text: root, sections (hash, paragraphs (hash, runs)).

    Runs are the leaves. A paragraph's hash is the SHA-256 of its runs' hashes, a section's that of its paragraphs' hashes, the root's that of its sections' hashes and of the blank
    lines between them, so roots are equal for equal texts and only for them. runs: the first SHORT digits of the hashes of a paragraph's runs,
    in order. Texts of any length and script are cut by one rule. Null counts as the empty text: one section with one empty paragraph without runs.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))

    def paragraph(p: Column) -> Column:
        hashes = F.transform(F.regexp_extract_all(F.hex(p.cast("binary")), F.lit(RUNS), 0), lambda r: F.sha2(r, 256))
        return common.let(hashes, lambda h: F.struct(F.sha2(F.array_join(h, ""), 256).alias("hash"), F.array_join(F.transform(h, lambda x: F.left(x, F.lit(SHORT))), "").alias("runs")))

    def section(s: Column) -> Column:
        made = F.transform(F.split(s, PARAGRAPH, -1), paragraph)
        return common.let(made, lambda ps: F.struct(F.sha2(F.array_join(F.transform(ps, lambda p: p["hash"]), ","), 256).alias("hash"), ps.alias("paragraphs")))

    between = F.array_join(F.transform(F.regexp_extract_all(whole, F.lit(SECTION), 0), lambda s: F.sha2(s, 256)), ",")
    sections = F.transform(F.split(whole, SECTION, -1), section)
    return common.let(sections, lambda ss: F.struct(F.sha2(F.concat(F.array_join(F.transform(ss, lambda s: s["hash"]), ","), F.lit(";"), between), 256).alias("root"), ss.alias("sections")))


def _runs(node: Column) -> Column:
    """The runs of a whole tree as one string."""
    return F.array_join(F.transform(node["sections"], lambda s: F.array_join(F.transform(s["paragraphs"], lambda p: p["runs"]), "")), "")


def written(node: Column) -> Column:
    """A tree as one string: the root's hash, a colon, the runs' hashes."""
    return F.concat(node["root"], F.lit(":"), _runs(node))


def _numbered(names: Column) -> Column:
    """An array in which equal names are told apart: each gets a colon and which of its equals it is, from 1. Names hold no comma or colon."""
    groups = F.regexp_extract_all(F.concat(F.array_join(F.sort_array(names), ","), F.lit(",")), F.lit(r"([^,]+,)\1*"), 0)

    def each(group: Column) -> Column:
        return common.let(F.substring_index(group, ",", 1), lambda name: F.transform(F.sequence(F.lit(1), F.floor(F.length(group) / (F.length(name) + 1)).cast("int")), lambda k: F.concat(name, F.lit(":"), k.cast("string"))))

    return F.flatten(F.transform(groups, each))


def _branches(names: Column, mark: str) -> Column:
    """The branches below numbered nodes, which are written as hash, `mark`, branches with blanks between."""
    below = F.transform(names, lambda x: F.split(F.substring_index(F.substring_index(x, ":", 1), mark, -1), " "))
    return F.filter(F.flatten(below), lambda x: x != "")


def _apart(a: Column, b: Column, body) -> Column:
    """body(the nodes of a that b lacks, those of b that a lacks), counted: of five equal nodes here and three there, two are left."""
    return common.let(F.struct(_numbered(a).alias("a"), _numbered(b).alias("b")), lambda n: body(F.array_except(n["a"], n["b"]), F.array_except(n["b"], n["a"])))


def likeness(a: Column, b: Column) -> Column:
    """How much of two trees is the same, from 0 to 1, by a walk into branches that differ only: 1 if the roots are equal, else twice the common runs and by the runs of both and their roots.

    Sections found in both trees, as often as in both, aren't looked into; nor are paragraphs of the other sections that are in both. Of what is
    left, runs are compared, with their counts. So it is the same as comparing all runs, and below 1 for unequal texts.
    """

    def paragraphs(s: Column) -> Column:
        return F.array_join(F.transform(s["paragraphs"], lambda p: F.concat(p["hash"], F.lit("|"), F.regexp_replace(p["runs"], f"(.{{{SHORT}}})", "$1/"))), " ")

    def sections(node: Column) -> Column:
        return F.transform(node["sections"], lambda s: F.concat(s["hash"], F.lit("="), paragraphs(s)))

    def leaves(names: Column) -> Column:
        return F.filter(F.flatten(F.transform(_branches(names, "|"), lambda r: F.split(r, "/"))), lambda r: r != "")

    def left(x: Column, y: Column) -> Column:
        """Runs of x and of y that the other lacks."""
        return _apart(x, y, lambda p, q: F.size(p) + F.size(q))

    both = F.length(_runs(a)) / SHORT + F.length(_runs(b)) / SHORT
    differ = _apart(sections(a), sections(b), lambda s, t: _apart(_branches(s, "="), _branches(t, "="), lambda p, q: left(leaves(p), leaves(q))))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise((both - differ) / (both + 2))


def differing(a: Column, b: Column) -> Column:
    """Where two trees differ: an array of (section, paragraph), from 0, that walks down only into branches whose hashes differ.

    A section or paragraph that one tree lacks counts as differing. Equal roots give an empty array at once.
    """

    def inside(i: Column) -> Column:
        x, y = F.get(a["sections"], i), F.get(b["sections"], i)
        n = F.greatest(F.coalesce(F.size(x["paragraphs"]), F.lit(0)), F.coalesce(F.size(y["paragraphs"]), F.lit(0)))
        rows = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(i.alias("section"), j.alias("paragraph")))
        changed = F.filter(rows, lambda r: ~F.get(x["paragraphs"], r["paragraph"])["hash"].eqNullSafe(F.get(y["paragraphs"], r["paragraph"])["hash"]))
        return F.when(x["hash"].eqNullSafe(y["hash"]), F.expr("cast(array() as array<struct<section: int, paragraph: int>>)")).otherwise(changed)

    n = F.greatest(F.size(a["sections"]), F.size(b["sections"]))
    none = F.expr("cast(array() as array<struct<section: int, paragraph: int>>)")
    return F.when(a["root"] == b["root"], none).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), inside)))


def fingerprints(df: DataFrame, text: str = "text", out: str = "tree") -> DataFrame:
    """df with the tree of every whole text. Rows are independent; a column named `out` is replaced, the others stay."""
    return df.withColumn(out, tree(F.col(text)))


def with_next(df: DataFrame, key: str = "doc_id", parts: int | None = None) -> tuple[DataFrame, Window]:
    """df's rows dealt so that each can see the next one by descending key: columns _bucket and _extra, and the window to look through.

    Keys are cut into ranges of about equal numbers of rows; each range also gets, marked _extra, a copy of the first
    rows of the range that follows it (of the first range, after the last). So one shuffle by range is enough, and no task sees more than its range. Null keys
    come last; rows with equal keys follow each other in the order of a hash of their texts. Drop rows with _extra after use.
    """
    spark = df.sparkSession
    parts = parts or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = common.split_points(df, key, parts)
    bucketed = df.withColumn("_bucket", F.coalesce(common.range_bucket(F.col(key), points), F.lit(0)))
    heads = [(r["_bucket"], r["head"]) for r in bucketed.groupBy("_bucket").agg(F.max(key).alias("head")).collect()]  # at most one per range
    heads.sort(reverse=True)
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    asks = F.broadcast(spark.createDataFrame(before, "_head long, _to int"))
    copies = F.when(F.col("_to").isNotNull(), F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("x")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("x")))).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("x"))))
    out = bucketed.join(asks, F.col(key).eqNullSafe(F.col("_head")), "left").withColumn("_c", F.explode(copies)).drop("_head", "_to", "_bucket")
    out = out.select("*", F.col("_c.b").alias("_bucket"), F.col("_c.x").alias("_extra"), F.xxhash64("text").alias("_tie")).drop("_c")
    return out, Window.partitionBy("_bucket").orderBy("_extra", F.col(key).desc_nulls_last(), "_tie")


def edited(df: DataFrame) -> DataFrame:
    """doc_id, text, n_chars and edited: the text whose last floor(n_chars/3) code points are replaced by the first as many, or all, of the next document.

    Null texts are empty. The next document is the one of the next lower doc_id; after the last comes the first, so a single document follows
    itself. Also tree and next_tree. An empty table gives an empty result.
    """
    docs = df.select("doc_id", common.whole_text().alias("text"))
    dealt, window = with_next(docs)
    cut = F.floor(F.length("text") / 3).cast("int")
    seen = dealt.withColumn("_next", F.lead("text").over(window))
    made = seen.select("doc_id", "_bucket", "_extra", "_tie", F.length("text").cast("long").alias("n_chars"), "text", F.concat(F.left("text", F.length("text") - cut), F.left("_next", cut)).alias("edited"), tree(F.col("text")).alias("tree"))
    return made.withColumn("next_tree", F.lead("tree").over(window)).where("_extra = 0")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and edited_at: the section:paragraph of every branch in which the edited text differs, comma-joined."""
    found = edited(common.read(spark, sf_dir, "documents")).withColumn("edited_tree", tree(F.col("edited")))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("tree")).alias("fingerprint"),
        written(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
        F.array_join(F.transform(differing(F.col("tree"), F.col("edited_tree")), lambda d: F.concat_ws(":", d["section"], d["paragraph"])), ",").alias("edited_at"),
    )


def _sql_tree(x: str, k: str) -> str:
    """Columns k_at (sections of paragraphs), k_runs (hashes of all runs) and k_root of a text."""
    runs = f"list_transform(regexp_extract_all(hex(encode(p)), '{RUNS}'), lambda r: sha256(r))"
    sections = f"list_transform(string_split_regex({x}, '\n[ \t\r]*\n'), lambda s: string_split(s, chr(10)))"
    paragraph = f"sha256(array_to_string({runs}, ''))"
    return f"""{sections} {k}_at,
  flatten(list_transform(flatten({sections}), lambda p: list_transform({runs}, lambda h: left(h, {SHORT})))) {k}_runs,
  sha256(array_to_string(list_transform({sections}, lambda s: sha256(array_to_string(list_transform(s, lambda p: {paragraph}), ','))), ',') || ';' ||
    array_to_string(list_transform(regexp_extract_all({x}, '\n[ \t\r]*\n'), lambda s: sha256(s)), ',')) {k}_root"""


#: Compares all runs by their counts, wherever they stand, and all paragraphs by position.
SQL = f"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id DESC) i, doc_id, coalesce(text, '') t FROM documents),
following AS (SELECT i, doc_id, t, length(t) n, coalesce(lead(t) OVER (ORDER BY i), first_value(t) OVER (ORDER BY i)) nt FROM docs),
edited AS (SELECT *, left(t, n - n // 3) || left(nt, n // 3) e FROM following),
trees AS MATERIALIZED (SELECT i, doc_id, n, e, {", ".join(_sql_tree(x, k) for k, x in (("a", "t"), ("b", "e"), ("c", "nt")))} FROM edited),
a AS (SELECT i, r, count(*) n FROM (SELECT i, unnest(a_runs) r FROM trees) GROUP BY ALL),
near AS (SELECT i, k, sum(least(a.n, o.n)) common FROM a JOIN (SELECT i, k, r, count(*) n FROM (SELECT i, 'b' k, unnest(b_runs) r FROM trees UNION ALL SELECT i, 'c', unnest(c_runs) FROM trees) GROUP BY ALL) o USING (i, r) GROUP BY ALL)
SELECT doc_id, n::bigint n_chars, sha256(e) edited_sha256, a_root || ':' || array_to_string(a_runs, '') fingerprint, b_root || ':' || array_to_string(b_runs, '') edited_fingerprint,
  {", ".join(f"CASE WHEN a_root = {k}_root THEN 1.0::double ELSE 2.0::double * coalesce((SELECT common FROM near WHERE near.i = trees.i AND near.k = '{k}'), 0) / (len(a_runs) + len({k}_runs) + 2) END {name}" for k, name in (("b", "near_edited"), ("c", "near_next")))},
  array_to_string(flatten(list_transform(range(greatest(len(a_at), len(b_at))), lambda s: list_transform(
    list_filter(range(greatest(coalesce(len(a_at[s + 1]), 0), coalesce(len(b_at[s + 1]), 0))), lambda p: a_at[s + 1][p + 1] IS DISTINCT FROM b_at[s + 1][p + 1]), lambda p: s || ':' || p))), ',') edited_at
FROM trees"""
