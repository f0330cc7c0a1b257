"""The batch pipeline over a database: each step reads tables, commits its own and logs its run, so any step can be run again alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..fixtures import Store
from ..operators import edges, tree
from ..sources import posts as source
from ..sources.database import Database, Transaction
from ..sources.store import Tables, numbered, settled
from . import hierarchy, steps  # noqa: F401  hierarchy registers its implementations

DEFAULTS = {
    "input": None,
    "min_score": 0,
    "detect": {"implementation": "regex"},
    "extract": {"implementation": "regex"},
    "canonize": {"implementation": "passthrough"},
    "infer": {"implementation": "tfidf"},
}


def load_config(path: str) -> dict:
    import yaml

    with open(path) as f:
        return DEFAULTS | (yaml.safe_load(f) or {})


#: Keys of the tables.
KEYS = {"posts": (schemas.POSTS, ["id"]), "relations": (schemas.RELATIONS, ["id"]), "members": (schemas.MEMBERS, ["id"]), "clusters": (schemas.CLUSTERS, ["id"]), "leaf_edges": (schemas.LEAF_EDGES, ["source_cluster_id", "target_cluster_id"])}


class Pipeline:
    """Steps 1 to 4 over a database below root. Each step commits all its tables together; its counts are taken while it writes, and logged with its run."""

    def __init__(self, spark: SparkSession, root: str, config: dict | None = None, buckets: int = 16):
        self.spark, self.db, self.tables, self.config, self.buckets = spark, Database(spark, root), Tables(spark, root), DEFAULTS | (config or {}), buckets

    def run(self, *numbers: int) -> None:
        for n in numbers or (1, 2, 3, 4):
            step = (self.detect, self.extract, self.canonize, self.infer)[n - 1]
            name = self.config[step.__name__]["implementation"]
            run = self.tables.log(step.__name__, name, "running")
            try:
                with self.db.begin() as tx:
                    seen = step(tx)
                counts = {k: o.get["n"] for k, o in seen.items()}
                self.tables.log(step.__name__, name, "done", run, rows_in=counts["rows_in"], rows_out=counts["rows_out"])
            except Exception as e:
                self.tables.log(step.__name__, name, "failed", run, error=str(e)[:500])
                raise

    def _table(self, tx: Transaction, name: str) -> str:
        if not tx.has(name):
            tx.create(name, *KEYS[name], self.buckets)
        return name

    def detect(self, tx: Transaction) -> dict[str, Observation]:
        posts, read = counted(source.read_posts(self.spark, self.config["input"], self.config["min_score"]))
        found, kept = counted(schemas.conform(steps.build("detect", self.config["detect"])(posts), schemas.POSTS))
        tx.merge(self._table(tx, "posts"), found)
        return {"rows_in": read, "rows_out": kept}

    def extract(self, tx: Transaction) -> dict[str, Observation]:
        posts, read = counted(tx.read("posts").select(F.col("id").alias("post_id"), "title"))
        found, kept = counted(steps.build("extract", self.config["extract"])(posts))
        tx.replace(self._table(tx, "relations"), schemas.conform(numbered(found, ["post_id", "cause_text", "effect_text"]), schemas.RELATIONS))
        return {"rows_in": read, "rows_out": kept}

    def canonize(self, tx: Transaction) -> dict[str, Observation]:
        titles = tx.read("posts").select(F.col("id").alias("post_id"), "title")
        relations, read = counted(tx.read("relations"))
        done, kept = counted(schemas.conform(steps.canonize(relations.join(titles, "post_id"), steps.build("canonize", self.config["canonize"])), schemas.RELATIONS))
        tx.merge("relations", done)
        return {"rows_in": read, "rows_out": kept}

    def infer(self, tx: Transaction) -> dict[str, Observation]:
        relations, read = counted(tx.read("relations").where("relation_type <> 'no_rel'"))
        clusters, members = steps.build("infer", self.config["infer"])(settled(relations, "relations"))
        tx.replace(self._table(tx, "members"), schemas.conform(numbered(members, ["relation_id", "role"]), schemas.MEMBERS))
        named, kept = counted(schemas.conform(tree.member_counts(clusters, members), schemas.CLUSTERS))
        tx.replace(self._table(tx, "clusters"), named)
        store = Store(*(tx.read(t) for t in ("posts", "relations", "clusters", "members")))
        tx.replace(self._table(tx, "leaf_edges"), schemas.conform(edges.leaf_edges(store), schemas.LEAF_EDGES))
        return {"rows_in": read, "rows_out": kept}

    def store(self) -> Store:
        state = self.db.version()
        return Store(*(self.db.read(t, state) for t in ("posts", "relations", "clusters", "members")))


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df, and the number of its rows as n once something has been written from it: counted on the way, without reading anything again."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen
