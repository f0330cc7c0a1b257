"""Schemas of the store and the one function that brings any table to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def _schema(text: str) -> T.StructType:
    """From 'name type, ...'; needs no session, so the module can be imported before there is one."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(", "))])


POSTS = _schema("id string, title string, score bigint, num_comments bigint, created_utc bigint, author string, url string, permalink string, subreddit string")
RELATIONS = _schema("id bigint, post_id string, cause_text string, effect_text string, cause_norm string, effect_norm string, cause_canonical string, effect_canonical string, confidence double, extractor string, relation_type string, extracted_at timestamp")
CLUSTERS = _schema("id bigint, label string, level int, parent_id bigint, member_count bigint, clusterer string, created_at timestamp")
MEMBERS = _schema("id bigint, cluster_id bigint, relation_id bigint, role string, event_text string")
RUNS = _schema("id bigint, step string, implementer string, started_at timestamp, finished_at timestamp, rows_in bigint, rows_out bigint, status string, error_msg string")
LEAF_EDGES = _schema("source_cluster_id bigint, target_cluster_id bigint, relation_count bigint, post_count bigint, avg_score double, countercausal_count bigint")

RELATION_TYPES = ("no_rel", "causal", "countercausal")
ROLES = ("cause", "effect")
STATUSES = ("running", "done", "failed")

#: What a column holds where a table lacks it or has null in it.
DEFAULTS = {"score": 0, "num_comments": 0, "subreddit": "science", "cause_canonical": "", "effect_canonical": "", "confidence": 1.0, "extractor": "", "relation_type": "causal", "member_count": 0, "clusterer": "", "countercausal_count": 0}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns, in its order and types: missing ones are added, null ones with a default are filled.

    A legacy is_countercausal flag fills a missing relation_type: 1 is countercausal, all else causal.
    """
    made = []
    for field in schema:
        default = DEFAULTS.get(field.name)
        if field.name in df.columns:
            column = F.col(field.name).cast(field.dataType)
            column = column if default is None else F.coalesce(column, F.lit(default).cast(field.dataType))
        elif field.name == "relation_type" and "is_countercausal" in df.columns:
            column = F.when(F.col("is_countercausal").cast("int") == 1, "countercausal").otherwise("causal")
        elif field.name in ("extracted_at", "created_at"):
            column = F.current_timestamp()
        else:
            column = F.lit(default).cast(field.dataType)
        made.append(column.alias(field.name))
    return df.select(*made)


def violations(posts: DataFrame, relations: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """(rule, n): how many rows break each constraint of the store. Keys, references, domains and the tree's invariants."""

    def broken(rule: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")

    def missing(rule: str, left: DataFrame, key: str, right: DataFrame, to: str) -> DataFrame:
        return broken(rule, left.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).join(right.select(F.col(to).alias("_k")), "_k", "left_anti"))

    parents = clusters.select(F.col("id").alias("parent_id"), F.col("level").alias("_up"))
    leaves = clusters.where("level = 0").select(F.col("id").alias("cluster_id"))
    parts = [
        broken("post id repeats", posts.groupBy("id").count().where("count > 1")),
        missing("relation without post", relations, "post_id", posts, "id"),
        missing("member without relation", members, "relation_id", relations, "id"),
        missing("member without cluster", members, "cluster_id", clusters, "id"),
        missing("cluster without parent", clusters, "parent_id", clusters, "id"),
        broken("unknown relation type", relations.where(~F.col("relation_type").isin(*RELATION_TYPES))),
        broken("unknown role", members.where(~F.col("role").isin(*ROLES))),
        broken("parent not one level up", clusters.join(parents, "parent_id").where("_up <> level + 1")),
        broken("member above the leaves", members.join(leaves, "cluster_id", "left_anti")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
