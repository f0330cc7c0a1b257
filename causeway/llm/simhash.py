"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by multi-index hashing, grouped by connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SEED = 42
HALF = 32
#: Buckets with more distinct fingerprints than this are linked by shared neighbours instead of pair by pair; the links' components are the same.
CROWD = 256
#: Shingles that are made and hashed at once; longer texts take several steps.
STEP = 1 << 14


def shingle_steps(text: str, size: int) -> Iterator[list[bytes]]:
    """The shingles of a text, repeats included, STEP at a time; all its words as one if they are fewer than a shingle, none without words."""
    words = text.encode().lower().split()
    if 0 < len(words) < size:
        yield [b" ".join(words)]
    for at in range(0, len(words) - size + 1, STEP):
        part = words[at : at + STEP + size - 1]
        yield list(map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False)))


def fingerprint(text: str, size: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit integer; zero without words."""
    votes, n = np.zeros(64, np.int64), 0
    hash_of = xxhash.xxh64_intdigest
    for shingles in shingle_steps(text, size):
        n += len(shingles)
        part = np.fromiter((hash_of(s, SEED) for s in shingles), np.uint64, len(shingles))
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "simhash", size: int = 3) -> DataFrame:
    """df with the 64-bit fingerprint of every whole text.

    Words are runs of other than ASCII white space, A to Z in lower case. Null, empty and blank texts have fingerprint zero; texts of fewer words
    than a shingle have one shingle of all their words. A column named `out` is replaced; others stay. Repeated rows get equal fingerprints.
    """
    common.small_batches(df.sparkSession)

    @F.arrow_udf(T.LongType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, size) if t else 0 for t in texts.to_pylist()], pa.int64())

    return df.withColumn(out, run(common.whole_text(text)))


def _segments(prints: DataFrame) -> DataFrame:
    """One row per fingerprint and half: part 0 has the low 32 bits, part 1 the high ones."""
    low, high = F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1)), F.shiftrightunsigned("fp", HALF)
    return prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("part"), low.alias("value")), F.struct(F.lit(1).alias("part"), high.alias("value")))).alias("s")).select("fp", "s.part", F.col("s.value").alias("key"))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column fp whose components are those of all pairs at two bits or fewer.

    Two fingerprints at two bits or fewer differ by one bit or none in one of their halves. So the table holds each half, and
    each fingerprint asks for all 33 values within one bit of each of its halves; what matches is kept if the complete distance is two at most. A
    bucket of over `crowd` fingerprints isn't paired: its fingerprints and those that ask for it each name the 65 values within
    one bit of themselves, and all that name the same value (two bits apart at most) are linked to the least of them. Both ways are exact.
    """
    table = _segments(prints)
    balls = common.literal([0, *(1 << i for i in range(HALF))], "bigint")
    asks = table.select("fp", "part", F.explode(balls).alias("mask"), "key").select("fp", "part", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    busy, path = common.materialize(table.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("part", "key"), "busy")
    if not busy.isEmpty():
        members = asks.join(busy, ["part", "key"], "left_semi").select("fp").distinct()
        near = common.literal([0, *(1 << i for i in range(63)), -(1 << 63)], "bigint")
        named = members.select("fp", F.explode(near).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
        least = named.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where(F.col("n") > 1).select("point", "a")
        shared = named.join(least.hint("merge"), "point").where(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b")).distinct()
        table, asks = table.join(busy, ["part", "key"], "left_anti"), asks.join(busy, ["part", "key"], "left_anti")
    else:
        shared = None
        common.discard(prints.sparkSession, path)
    x, y = asks.alias("x"), table.alias("y")
    apart = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    # shuffled: Spark sizes both sides as before their explodes, 66 times too low for one of them, and would broadcast it
    pairs = x.join(y.hint("merge"), (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (apart <= 2)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    return pairs if shared is None else pairs.unionByName(shared)


def groups(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, crowd: int = CROWD) -> DataFrame:
    """One row per row of df: key, fp and component (the least key that can be reached, its own included).

    Equal fingerprints form one class, so copies aren't paired. Rows with a null key belong to groups like others but never name them: a group
    of such rows only has component null. Repeated rows give repeated results; an empty table gives none.
    """
    marked, _ = common.materialize(with_fingerprint(df.select(key, text), text, "fp", size).select(key, "fp"), "simhash")
    classes = marked.groupBy("fp").agg(F.min(key).alias("least"))
    found = common.connected_components(links(classes.select("fp"), crowd)).select(F.col("node").alias("fp"), F.col("component").alias("of"))
    placed = classes.join(found, "fp", "left").select("fp", "least", F.coalesce("of", "fp").alias("of"))
    best = placed.groupBy("of").agg(F.min("least").alias("component"))
    return marked.join(placed.join(best, "of").select("fp", "component"), "fp").select(key, "fp", "component")


#: Bands of minimum hashes and hashes in each: two sets that share the fraction 0.8 agree in a band with probability 0.41, in one of 16 with 0.9998.
BANDS, ROWS = 16, 4
#: Words of 64 bits in the parity bitmap of a set.
LANES = 8
#: Shingles that count as common, texts of which one is looked at for them, and texts of one shingle in a cell.
OFTEN, SAMPLE, CELL = 1 << 18, 16, 2000
_MIX = np.random.default_rng(20240607).integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text, ascending; of all its words if they are fewer than a shingle."""
    parts = [np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in set(shingles)), np.uint64) for shingles in shingle_steps(text, size)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _bands_of(h: np.ndarray) -> list[int]:
    """One hash per band of the minimum hashes of a set; none for empty sets."""
    if not len(h):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        x = h[at : at + 1024, None] * _MIX[None, :]
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]


def prefix_of(h: np.ndarray, common_ones: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set in an order of all shingles, rare before common ones: so many that sets which share `similarity` have one of them in common."""
    if not len(h):
        return h
    often = np.isin(h, common_ones, assume_unique=True)
    # a little under the bound, so that rounding never shortens a prefix
    return np.concatenate([h[~often], h[often]])[: len(h) - int(np.ceil(similarity * len(h) - 1e-6)) + 1]


def parity(h: np.ndarray) -> list[int]:
    """LANES words of bits, each of which tells whether an odd number of shingles falls on it. Bitmaps of two sets never differ in more bits than the sets do in shingles."""
    odd = np.bincount((h >> np.uint64(7)) % np.uint64(64 * LANES), minlength=64 * LANES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


MARKS = T.StructType([T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("whole", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))])


def _marks(size: int, similarity: float, shared):
    """Of every text: fingerprint, bands, a 128-bit hash of its whole set of shingles, the size of the set, its prefix and its parity bitmap."""

    @F.arrow_udf(MARKS)
    def run(texts: pa.Array) -> pa.Array:
        prints, bands, whole, sizes, prefixes, bits = [], [], [], [], [], []
        for t in texts.to_pylist():
            prints.append(fingerprint(t))
            h = shingle_hashes(t, size)
            bands.append(_bands_of(h))
            whole.append(xxhash.xxh3_128_digest(h.tobytes()))
            sizes.append(len(h))
            prefixes.append(prefix_of(h, shared.value, similarity).view(np.int64))
            bits.append(parity(h))
        longs = lambda x: pa.array(x, pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array(prints, pa.int64()), longs(bands), pa.array(whole, pa.binary()), pa.array(sizes, pa.int32()), longs(prefixes), longs(bits)], names=MARKS.names)

    return run


def _sets(size: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(t, size).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return run


def _common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles of many texts, at most OFTEN, as found in one text of SAMPLE. They only set the order of shingles: any order gives the same groups, a good one fewer pairs."""
    some = docs.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select(_sets(size)("text").alias("set"))
    # outer: otherwise Spark infers a filter on the sets and has Python make all of them twice, in a second worker for each core
    found = some.select(F.explode_outer("set").alias("h")).where("h is not null").groupBy("h").agg(F.count("*").alias("n")).where("n > 3").orderBy(F.desc("n"), "h").limit(OFTEN)
    table, path = common.materialize(found.select("h"), "common")
    out = np.sort(table.toArrow().column("h").to_numpy().view(np.uint64))
    common.discard(docs.sparkSession, path)
    return out


def _documents(df: DataFrame, text: str, key: str) -> tuple[DataFrame, list[str]]:
    """(node, text), one row per key that isn't null: of rows that repeat a key the one of the greatest text."""
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).alias("node"), common.whole_text(text).alias("text"))
    again, path = common.materialize(docs.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "again")
    if again.isEmpty():
        common.discard(df.sparkSession, path)
        return docs, []
    ids = common.sized(again)
    return docs.join(ids, "node", "left_anti").unionByName(docs.join(ids, "node", "left_semi").groupBy("node").agg(F.max("text").alias("text"))), [path]


def _print_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): classes whose fingerprints are equal or at two bits or fewer, by multi-index hashing; equal ones each with the least class of their fingerprint."""
    first = classes.groupBy("fp").agg(F.min("node").alias("node"))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("node").alias(f"n{c}"))
    alike = links(first.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return alike.unionByName(classes.join(first.withColumnRenamed("node", "a"), "fp").where("a < node").select("a", F.col("node").alias("b")))


def _band_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): each class with the class most like it among the middles of its buckets, one bucket for each band.

    The middle of a bucket is the class that meets most others in all of its buckets, as the original of many edited copies does. So large groups
    get one pair for each class, and most of them are joined.
    """
    flat = classes.select("node", F.posexplode("bands").alias("i", "h")).select("node", F.xxhash64("i", "h").alias("bucket"))
    buckets, b_path = common.materialize(flat.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    most = common.hub_bound(int(buckets.agg(F.sum("n")).first()[0] or 0))
    held, h_path = common.materialize(common.spread_join(flat, buckets, "bucket", most), "held")
    scored = held.join(held.groupBy("node").agg(F.sum("n").alias("met")).hint("merge"), "node")
    middles = scored.groupBy("bucket").agg(F.max_by("node", F.struct("met", F.col("node"))).alias("middle"), F.count("*").alias("n"))
    met = common.spread_join(held.drop("n"), middles, "bucket", most).where("node <> middle").groupBy("node", "middle").agg(F.count("*").alias("n"))
    best = met.groupBy("node").agg(F.max_by("middle", F.struct("n", "middle")).alias("middle"))
    out, path = common.materialize(best.select(F.col("middle").alias("a"), F.col("node").alias("b")), "middles")
    common.discard(classes.sparkSession, b_path, h_path)
    return out


def _prefix_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of rows (node, component, size, prefix, bits) in different components that can share `similarity` by their prefixes, lengths, positions and bitmaps.

    If two sets share that much, their first common shingle leaves enough of both behind it; in the smaller set it then stands in the first part of the prefix (`near`). Shingles
    whose texts are all in one component, or that are near in none, make no pairs. Those of many texts are dealt to cells: each text is in one cell and meets all others there.
    """
    spark, share = rows.sparkSession, 2 * similarity / (1 + similarity)
    flat = rows.select("node", "component", "size", "bits", F.posexplode("prefix").alias("pos", "token")).withColumn("near", F.col("size") - F.col("pos") >= F.ceil(share * F.col("size") - 1e-6))
    live = flat.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("near").alias("near"), F.count("*").alias("n")).where("lo < hi and near")
    live, path = common.materialize(live.select("token", F.ceil(F.col("n") / CELL).cast("int").alias("cells")), "live")
    held, held_path = common.materialize(flat.join(common.sized(live), "token").select("*", *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(LANES)]).drop("bits"), "prefixes")
    common.discard(spark, path)
    x = held.where("near").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).alias("x")
    y = held.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")).alias("y")
    sx, sy = F.col("x.size"), F.col("y.size")
    least = F.ceil(F.lit(share / 2) * (sx + sy) - 1e-6)
    smaller = (sx < sy) | ((sx == sy) & (F.col("x.node") < F.col("y.node")))
    fits = smaller & (sx >= similarity * sy - 1e-6) & (sx - F.col("x.pos") >= least) & (sy - F.col("y.pos") >= least)
    # the sets differ in as many shingles at least
    apart = sum((F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(1, LANES)), F.bit_count(F.col("x.b0").bitwiseXOR(F.col("y.b0"))))
    fits = fits & (apart <= (sx + sy) - 2 * least)
    met = x.join(y.hint("merge"), (F.col("x.token") == F.col("y.token")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.component") != F.col("y.component")) & fits)
    out, out_path = common.materialize(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "met")
    common.discard(spark, held_path)
    return out


def _similar(docs: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles share `similarity` or more."""
    wanted, path = common.materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    sets, s_path = common.materialize(docs.join(common.sized(wanted), "node", "left_semi").select("node", _sets(size)("text").alias("set")), "sets")
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    out, _ = common.materialize(both.where(F.col("shared") >= similarity * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b"), "alike")
    common.discard(docs.sparkSession, path, s_path)
    return out


def near_groups(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per key of df: key and component, the least key of its group of near copies.

    Texts are near copies if their sets of shingles of `size` words share `similarity` or more (Jaccard), counted exactly. Texts with equal sets are one class.
    Classes are first compared where they are easily found: fingerprints at two bits or fewer (links()), and one class each that shares bands of minimum hashes. That joins
    large groups without all of their pairs. Then every pair of classes in different groups that can be similar at all is compared (_prefix_pairs()), so
    no link between groups is missed, however many texts share a template.
    Blank texts are copies of each other. Rows with a null key are left out; of rows that repeat a key the greatest text counts. An empty table gives none.
    """
    common.small_batches(df.sparkSession)
    spark = df.sparkSession
    docs, _ = _documents(df, text, key)
    shared = spark.sparkContext.broadcast(_common_shingles(docs, size))
    rows = docs.select("node", _marks(size, similarity, shared)("text").alias("m"))
    marked, m_path = common.materialize(rows.select("node", "m.fp", "m.bands", "m.size", "m.prefix", "m.bits", F.col("m.whole").alias("cls")), "near")
    first, f_path = common.materialize(marked.groupBy("cls").agg(F.min("node").alias("node")), "first")
    classes = marked.join(common.sized(first.select("node")), "node", "left_semi")
    pairs, p_path = common.materialize(_print_pairs(classes.select("node", "fp")).unionByName(_band_pairs(classes.select("node", "bands"))).distinct(), "pairs")
    found = common.connected_components(_similar(docs, pairs, size, similarity))
    placed, placed_path = common.materialize(first.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "placed")
    more = _prefix_pairs(classes.select("node", "size", "prefix", "bits").join(common.sized(placed), "node"), similarity)
    of = lambda c: placed.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    added = _similar(docs, more, size, similarity).join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = common.connected_components(added).select(F.col("node").alias("component"), F.col("component").alias("final"))
    final = first.join(placed, "node").join(joined, "component", "left").select("cls", F.coalesce("final", "component").alias("component"))
    out, _ = common.materialize(marked.select("node", "cls").join(final, "cls").select(F.col("node").alias(key), "component"), "groups")
    common.discard(spark, m_path, f_path, p_path, placed_path)
    return out


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df that stay: of each group of near copies (near_groups()) the one with the least key.

    Rows that repeat that key stay once. Rows without a key stay, but for exact copies among themselves. Columns stay as they are. Texts move only if
    the ids that go are too many to be broadcast.
    """
    found = near_groups(df, text, key, size, similarity)
    gone = common.sized(found.where(F.col("component") != F.col(key)).select(key))
    kept = df.where(F.col(key).isNotNull()).join(gone, key, "left_anti")
    repeated, _ = common.materialize(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "repeated")
    if not repeated.isEmpty():
        kept = kept.join(common.sized(repeated), key, "left_anti").unionByName(kept.join(common.sized(repeated), key, "left_semi").dropDuplicates([key]))
    bare = df.where(F.col(key).isNull()).dropDuplicates([text])
    return kept.select(df.columns).unionByName(bare.select(df.columns))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
