"""What a reader of the graph sees: opened nodes, neighbourhoods, differences, statistics and flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .edges import majority_refuted


def ranked_union(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, one per key; those of first win, then the least row."""
    both = first.withColumn("_rank", F.lit(0)).unionByName(second.withColumn("_rank", F.lit(1)))
    return both.groupBy(*keys).agg(F.min(F.struct("_rank", F.struct(*first.columns).alias("row"))).alias("_m")).select("_m.row.*")


def visible(nodes: DataFrame, edges: DataFrame, opened: DataFrame, inner_nodes: DataFrame, inner_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) in view: opened nodes give way to inner ones; edges of both, once per pair, with both ends in view, flagged if mostly refuted."""
    gone = opened.select("id").distinct()
    seen = ranked_union(nodes, inner_nodes, ["id"]).join(gone, "id", "left_anti")
    merged = ranked_union(edges, inner_edges, ["source_cluster_id", "target_cluster_id"])
    for end in ("source_cluster_id", "target_cluster_id"):
        merged = merged.join(seen.select(F.col("id").alias(end)), end, "left_semi")
    return seen, majority_refuted(merged.select(edges.columns))


def difference(now: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """(key, change): what to remove from now and to add to it to reach target."""
    a, b = now.select(key).distinct(), target.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("change", F.lit("remove")).unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("add")))


def neighbourhood(edges: DataFrame, node: int) -> DataFrame:
    """(id, side): the node itself, those its edges lead to and those whose edges lead to it."""
    out = edges.where(F.col("source_cluster_id") == node).select(F.col("target_cluster_id").alias("id"), F.lit("out").alias("side"))
    into = edges.where(F.col("target_cluster_id") == node).select(F.col("source_cluster_id").alias("id"), F.lit("in").alias("side"))
    own = edges.sparkSession.createDataFrame([(node, "self")], "id bigint, side string")
    return out.unionByName(into).unionByName(own).distinct()


def dimmed(nodes: DataFrame, edges: DataFrame, node: int) -> DataFrame:
    return nodes.join(neighbourhood(edges, node).select("id").distinct(), "id", "left_anti").select("id")


def density(edges: Column, nodes: Column) -> Column:
    """Edges of a directed graph as a share of all that its nodes could have; 0 for fewer than two nodes."""
    return F.coalesce(F.try_divide(edges.cast("double"), nodes * (nodes - 1)), F.lit(0.0))


def statistics(edges: DataFrame, node_count: Column | int) -> DataFrame:
    """One row: relations, countercausal and causal ones, their rates, the density of the directed graph, posts per edge. Empty graphs give 0."""
    n = F.lit(node_count).cast("double") if isinstance(node_count, int) else node_count
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sums = edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum("relation_count"), F.lit(0)).cast("bigint").alias("relations"), F.coalesce(F.sum("countercausal_count"), F.lit(0)).cast("bigint").alias("countercausal"), F.coalesce(F.sum("post_count"), F.lit(0)).cast("bigint").alias("posts"))
    real = lambda c: F.col(c).cast("double")
    return sums.select("edges", "relations", "countercausal", (F.col("relations") - F.col("countercausal")).alias("causal"), safe(real("countercausal"), real("relations")).alias("refuted_rate"), density(F.col("edges"), n).alias("density"), safe(real("posts"), real("edges")).alias("posts_per_edge"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges that a node is an end of."""
    ends = F.array("source_cluster_id", "target_cluster_id")
    return edges.select(F.explode(ends).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def flows(edges: DataFrame) -> DataFrame:
    """(id, inflow, outflow, size): posts into and out of a node; size is the greater."""
    side = F.array(F.struct(F.col("source_cluster_id").alias("id"), F.lit(0).cast("bigint").alias("i"), F.col("post_count").alias("o")), F.struct(F.col("target_cluster_id").alias("id"), F.col("post_count").alias("i"), F.lit(0).cast("bigint").alias("o")))
    return edges.select(F.explode(side).alias("s")).groupBy("s.id").agg(F.sum("s.i").alias("inflow"), F.sum("s.o").alias("outflow")).withColumn("size", F.greatest("inflow", "outflow"))


def ribbons(edges: DataFrame, height: float = 400.0, least: float = 2.0) -> DataFrame:
    """edges with the height of their ribbon and where it starts at its source: shares of all posts, `least` at least, stacked in order of posts."""
    whole = edges.agg(F.sum("post_count").alias("_all"))
    sized = edges.crossJoin(F.broadcast(whole)).withColumn("height", F.greatest(F.lit(least), F.lit(height) * F.col("post_count") / F.col("_all"))).drop("_all")  # one row
    stack = Window.partitionBy("source_cluster_id").orderBy(F.col("post_count").desc(), "target_cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("start", F.coalesce(F.sum("height").over(stack), F.lit(0.0)))


def scaled(x: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """x from [low, high], clamped, to [to_low, to_high]."""
    return F.lit(to_low) + F.lit(to_high - to_low) * (F.least(F.greatest(x.cast("double"), F.lit(float(low))), F.lit(float(high))) - F.lit(float(low))) / F.lit(float(high - low))


def selected(cause: Column, effect: Column, selection: Column) -> Column:
    """Whether a relation shows: with nothing selected all do, with one event those it is an end of, with more those with both ends selected."""
    c, e = F.array_contains(selection, cause), F.array_contains(selection, effect)
    return F.when(F.size(selection) == 0, F.lit(True)).when(F.size(selection) == 1, c | e).otherwise(c & e)


def toggled(selection: Column, item: Column) -> Column:
    return F.when(F.array_contains(selection, item), F.array_remove(selection, item)).otherwise(F.array_append(selection, item))


def event_spans(relations: DataFrame) -> DataFrame:
    """(post_id, start, end, role, canonical): where the ends of relations (id, post_id, title, texts, canonical forms) stand in their titles; each place and role once, of the relation of least id.

    Ends that don't stand in the title are left out.
    """
    side = lambda r: F.struct(F.lit(r).alias("role"), F.col(f"{r}_text").alias("text"), F.coalesce(F.nullif(f"{r}_canonical", F.lit("")), F.col(f"{r}_text")).alias("canonical"))
    rows = relations.select("id", "post_id", "title", F.explode(F.array(side("cause"), side("effect"))).alias("s"))
    at = F.instr(F.lower("title"), F.lower("s.text"))
    found = rows.select("id", "post_id", "s.role", "s.canonical", (at - 1).alias("start"), (at - 1 + F.length("s.text")).alias("end")).where("start >= 0")
    return found.groupBy("post_id", "start", "end", "role").agg(F.min_by("canonical", "id").alias("canonical"))


def segments(posts: DataFrame, spans: DataFrame) -> DataFrame:
    """(post_id, start, end, text, events): a title (post_id, title) cut at every end of a span; events are the spans that cover the piece, longest first."""
    grouped = spans.groupBy("post_id").agg(F.collect_list(F.struct("start", "end", "role", "canonical")).alias("spans"))
    joined = posts.select("post_id", "title").join(grouped, "post_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(grouped.schema["spans"].dataType)))
    points = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.length("title")), F.transform("spans", lambda s: s["start"]), F.transform("spans", lambda s: s["end"]))))
    cuts = joined.withColumn("_p", points).withColumn("_i", F.explode(F.expr("sequence(0, greatest(size(_p) - 2, 0))"))).select("post_id", "title", "spans", F.get("_p", F.col("_i")).alias("start"), F.coalesce(F.get("_p", F.col("_i") + 1), F.col("_p")[0]).alias("end"))
    over = F.filter("spans", lambda s: (s["start"] <= F.col("start")) & (s["end"] >= F.col("end")))
    ordered = F.transform(F.array_sort(F.transform(over, lambda s: F.struct((s["start"] - s["end"]).alias("k"), s["start"].alias("start"), s["role"].alias("role"), s["canonical"].alias("canonical")))), lambda s: F.struct(s["role"].alias("role"), s["canonical"].alias("canonical")))
    return cuts.select("post_id", "start", "end", F.substring(F.col("title"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), ordered.alias("events")).where("start < end")


def without_overlap(spans: Column) -> Column:
    """An array of spans (start, end, ...) by start, without those that begin before the one kept last has ended."""
    kind = F.array().cast("array<struct<start: int, end: int>>")

    def step(acc, s):
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(F.array_append(acc["out"], F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("out"), s["end"].alias("at")))

    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(plain, F.struct(kind.alias("out"), F.lit(0).alias("at")), step)["out"]
