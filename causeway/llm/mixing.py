"""Mixing sources to target weights: pivotal dependent rounding of copy numbers in a distributed reduction tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Rows that one step of the tree rounds together, on average; groups are dealt by hash.
GROUP = 512
#: A probability nearer than this to 0 or 1 counts as integral.
TINY = 1e-9


def size_of(text: str = "text") -> Column:
    """Words of a text: runs of other than ASCII white space; 0 for null."""
    return F.regexp_count(common.whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources (one row per source) with part: its number from 0 in code point order, null last. Numbers come from ranges, so no task sees all sources."""
    spark = sources.sparkSession
    order = F.col("source").asc_nulls_last()
    cut = sources.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_range", F.spark_partition_id())
    cut, _ = common.materialize(cut, "sources")
    before, starts = 0, []
    for r in cut.groupBy("_range").count().orderBy("_range").collect():  # one row per range, a number that the session sets
        starts.append((r["_range"], before))
        before += r["count"]
    table = F.broadcast(spark.createDataFrame(starts, "_range int, _start long"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return cut.withColumn("_number", number).join(table, "_range").withColumn("part", F.col("_start") + F.col("_number")).drop("_range", "_start", "_number")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, total; one row per source, null for those without; other columns stay) with part, weight and target: what each source shall give.

    Sources in code point order, null last, get the weights in turn and share `share` times all sizes by weight; a target above `most` times its
    source's size stops there and its excess is shared again among the others by weight, until none is above. Each round of that is one sum over the
    table of sources. If all are at their most, that is what they give.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked(sizes.withColumn("total", F.coalesce("total", F.lit(0)))).withColumn("weight", F.get(table, F.pmod("part", F.lit(len(weights))).cast("int")))
    weighed, _ = common.materialize(weighed, "weights")
    top = F.col("total") * F.lit(float(most))
    left = share * (weighed.agg(F.sum("total").alias("s")).first()["s"] or 0)
    level, free = None, -1
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") > top
        r = weighed.agg(F.sum(F.when(over, top).otherwise(0.0)).alias("given"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("whole"), F.count(F.when(~over, 1)).alias("free")).first()
        if r["free"] in (0, free):
            break
        level, free = (left - r["given"]) / r["whole"], r["free"]
    return weighed.withColumn("target", F.least(F.lit(level or 0.0) * F.col("weight"), top))


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _together(items: Column, seed: int) -> Column:
    """One pass of the pivotal method over an array of (size, id, p), largest first, of equal p: each row is paired with all that follow it, and the pair passes words until one of the two is integral.

    What the rows behind give or take is shared by all of them, so their probabilities, a * p + b, stay equal. If they run out of words, or
    can take no more, all of them are integral, and the row stays fractional; else it is decided, and the next one has its turn. Returns (left, done): the
    rows still fractional, one at most, and (id, copy) of all others.
    """
    struct = "size: bigint, id: bigint, p: double"
    start = F.struct(
        F.expr(f"cast(array() as array<struct<{struct}>>)").alias("left"),
        F.expr("cast(array() as array<struct<id: bigint, copy: bigint>>)").alias("done"),
        F.lit(1.0).alias("a"),
        F.lit(0.0).alias("b"),
        F.aggregate(items, F.lit(0).cast("bigint"), lambda n, x: n + x["size"]).alias("size"),
        F.aggregate(items, F.lit(0.0), lambda n, x: n + x["size"] * x["p"]).alias("words"),
    )

    def step(acc, x):
        size = x["size"]

        def turn(m: Column) -> Column:
            """m: the row's p, and the size and words of the rows behind."""
            p, behind, words = m["p"], m["size"], m["words"]
            # words by which the row can grow at the others' cost, and shrink in their favour; either way the sum of words stays, and so does each one's expectation
            fractional = (p > TINY) & (p < 1.0 - TINY)
            grow = F.when(fractional, F.least(size * (1.0 - p), words)).otherwise(0.0)
            shrink = F.when(fractional, F.least(size * p, behind - words)).otherwise(0.0)
            up = _unit(x["id"], F.lit(seed)) * (grow + shrink) < shrink
            part = F.coalesce(F.when(up, F.try_divide(grow, words)).otherwise(F.try_divide(shrink, behind - words)), F.lit(0.0))
            return common.let(F.struct(up.alias("up"), F.when(up, grow).otherwise(-shrink).alias("by"), part.alias("part")), lambda move: moved(m, move))

        def moved(m: Column, move: Column) -> Column:
            p, keep = m["p"] + move["by"] / size, 1.0 - move["part"]
            row = F.array(F.struct(size.alias("size"), x["id"].alias("id"), p.alias("p")))
            return F.struct(
                F.concat(acc["left"], F.filter(row, lambda r: (r["p"] > TINY) & (r["p"] < 1.0 - TINY))).alias("left"),
                F.concat(acc["done"], F.transform(F.filter(row, lambda r: (r["p"] <= TINY) | (r["p"] >= 1.0 - TINY)), lambda r: F.struct(r["id"].alias("id"), F.round(r["p"]).cast("bigint").alias("copy")))).alias("done"),
                (acc["a"] * keep).alias("a"),
                (acc["b"] * keep + F.when(move["up"], 0.0).otherwise(move["part"])).alias("b"),
                m["size"].alias("size"),
                (m["words"] - move["by"]).alias("words"),
            )

        p = acc["a"] * x["p"] + acc["b"]
        behind = acc["size"] - size
        return common.let(F.struct(p.alias("p"), behind.alias("size"), F.greatest(F.lit(0.0), F.least(behind.cast("double"), acc["words"] - size * p)).alias("words")), turn)

    return F.aggregate(items, start, step, lambda acc: F.struct(acc["left"].alias("left"), acc["done"].alias("done")))


def _pairs(items: Column, seed: int) -> Column:
    """One pass of the pivotal method over an array of (size, id, p) of any probabilities: each pair passes words until one of the two is integral.

    Returns (left, done): an array of the row that is still fractional, if there is one, and (id, copy) of all others.
    """
    null = F.expr("cast(null as struct<size: bigint, id: bigint, p: double>)")
    none = F.expr("cast(array() as array<struct<id: bigint, copy: bigint>>)")

    def step(acc, b):
        a = acc["left"]
        # words by which a can grow at b's cost, and shrink in b's favour; either way the sum of size * p stays, and so does each one's expectation
        grow = F.least(a["size"] * (1.0 - a["p"]), b["size"] * b["p"])
        shrink = F.least(a["size"] * a["p"], b["size"] * (1.0 - b["p"]))
        up = _unit(a["id"], b["id"], F.lit(seed)) * (grow + shrink) < shrink
        by = F.when(up, grow).otherwise(-shrink)

        def settle(m: Column) -> Column:
            pair = F.array(m["a"], m["b"])
            open_ = F.filter(pair, lambda x: (x["p"] > TINY) & (x["p"] < 1.0 - TINY))
            shut = F.filter(pair, lambda x: (x["p"] <= TINY) | (x["p"] >= 1.0 - TINY))
            return F.struct(F.get(open_, F.lit(0)).alias("left"), F.concat(acc["done"], F.transform(shut, lambda x: F.struct(x["id"].alias("id"), F.round(x["p"]).cast("bigint").alias("copy")))).alias("done"))

        def item(x, p):
            return F.struct(x["size"].alias("size"), x["id"].alias("id"), p.alias("p"))

        moved = F.struct(item(a, a["p"] + by / a["size"]).alias("a"), item(b, b["p"] - by / b["size"]).alias("b"))
        return F.when(a.isNull(), F.struct(b.alias("left"), acc["done"].alias("done"))).otherwise(common.let(moved, settle))

    return F.aggregate(items, F.struct(null.alias("left"), none.alias("done")), step, lambda acc: F.struct(F.array_compact(F.array(acc["left"])).alias("left"), acc["done"].alias("done")))


def pivotal(rows: DataFrame, seed: int = 7, group: int = GROUP) -> DataFrame:
    """Rounds fractional probabilities dependently. rows: part, n (rows of the part, or more), id, size > 0, and p with 0 < p < 1, the same in a whole part; returns part, id, copy (0 or 1).

    Pairs pass words (size times p), not bare probability, so the words of a part are kept. Each level of the tree deals the rows of a part by hash to
    groups of about `group`, so that a part of any size is spread over all tasks; inside a group the largest are decided first, on the first level each
    against all that follow, so what is left is small. What stays fractional, one row per group at most, goes to the next level, until each part is one group; its last row is drawn
    by its own probability. So the sum of size * copy differs from that of size * p by less than the size of one row. Draws depend on ids only, so reruns
    agree; ids must differ within a part.
    """
    most = rows.agg(F.max("n").alias("n")).first()["n"] or 0
    decided, level = [], 0
    while True:
        groups = F.greatest(F.lit(1), F.ceil(F.col("n") / group)).cast("long")
        dealt = rows.withColumn("_groups", groups).withColumn("_g", F.pmod(F.xxhash64("id", F.lit(seed + level)), F.col("_groups")))
        packed = dealt.groupBy("part", "_g").agg(F.max("_groups").alias("n"), F.sort_array(F.collect_list(F.struct("size", "id", "p")), asc=False).alias("items"))
        out, _ = common.materialize(packed.select("part", "n", (_pairs if level else _together)(F.col("items"), seed + level).alias("r")).select("part", "n", "r.left", "r.done"), "mix")
        decided.append(out.select("part", F.explode("done").alias("d")).select("part", "d.id", "d.copy"))
        rows = out.select("part", "n", F.explode("left").alias("l")).select("part", "n", "l.id", "l.size", "l.p")
        level += 1
        if most <= group:
            break
        most = -(-most // group)
    decided.append(rows.select("part", "id", (_unit(F.col("id"), F.lit(seed + 1000)) < F.col("p")).cast("bigint").alias("copy")))
    whole = decided[0]
    for d in decided[1:]:
        whole = whole.unionByName(d)
    return whole


def plan(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """How often the mix takes each row of df (doc_id, text, source): doc_id, row, size, source_size, target, copies.

    A row of a source with target t and size s is taken floor(t/s) times and once more with the fractional part as its probability, rounded by pivotal(), so a source's words miss
    its target by less than its longest document. `row` is a hash of the id and the text that pairs results with rows. Null texts have size 0, and rows of size 0
    are drawn each for itself; a null source is a source of its own; a source of size 0 has target 0 and gives nothing. Rows equal in id, source and text share one
    decision, with all their words: a source that is one such row over and over gives all or nothing of a copy. An empty table gives an empty result.
    The table of sources stays in Spark. It is broadcast up to common.SMALL rows; beyond, it is shuffled, with its largest sources looked up.
    """
    narrow = df.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), F.xxhash64(F.col("doc_id"), common.whole_text(), F.col("source")).alias("row"), size_of().alias("size"))
    narrow, _ = common.materialize(narrow, "sizes")
    sources = narrow.groupBy("key").agg(F.sum("size").alias("total"), F.count("*").alias("n")).withColumn("source", F.when(F.col("key") != "", F.substr("key", F.lit(2))))
    ratio = F.when(F.col("total") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("total"))).otherwise(0.0)
    shares = targets(sources, weights, share, most).withColumn("_ratio", ratio).withColumn("base", F.floor(F.col("_ratio") + TINY)).withColumn("p", F.col("_ratio") - F.col("base"))
    quotas, _ = common.materialize(shares.select("key", "part", "n", F.col("total").alias("source_size"), "target", "base", F.when(F.col("p") < TINY, 0.0).otherwise(F.col("p")).alias("p")), "quotas")
    if quotas.limit(common.SMALL + 1).count() <= common.SMALL:
        placed = narrow.join(F.broadcast(quotas), "key")
    else:
        placed = common.spread_join(narrow, quotas, "key", common.hub_bound(narrow.count()))
    unsure = placed.where("p > 0 and size > 0").groupBy("part", F.col("row").alias("id")).agg(F.max("n").alias("n"), F.sum("size").alias("size"), F.max("p").alias("p"))
    chosen = pivotal(unsure, seed).where("copy = 1").select("part", F.col("id").alias("row"), F.lit(1).cast("bigint").alias("_more"))
    alone = F.when((F.col("size") == 0) & (_unit(F.col("row"), F.lit(seed + 2000)) < F.col("p")), 1).otherwise(0)
    return placed.join(chosen, ["part", "row"], "left").select("doc_id", "row", "size", "source_size", "target", (F.col("base") + F.coalesce("_more", alone)).alias("copies"))


def mix(df: DataFrame, **options) -> DataFrame:
    """The rows of df as often as the mix takes them, columns as they are; rows that it doesn't take are left out.

    Texts move only if the copy numbers, a row of two integers for each text taken, are too many to be broadcast.
    """
    names = common.free_names(df, "row", "copies")
    row, copies = names["row"], names["copies"]
    found, _ = common.materialize(plan(df, **options).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies)).dropDuplicates([row]), "copies")
    keyed = df.withColumn(row, F.xxhash64(F.col("doc_id"), common.whole_text(), F.col("source")))
    return keyed.join(common.sized(found), row).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))).select(df.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plan(common.read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
