"""A training-data pipeline over documents, stage by stage; each stage works on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents. run() applies them to the whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import bpe, common, mixing, pii, quality, simhash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble, fitted on the labels of sf_dir, scores below its threshold."""
    model = quality.train(docs, common.read(spark, sf_dir, "labels"))
    out = common.free_names(docs, "score")["score"]
    return quality.score(docs, model, out=out).where(F.col(out) >= quality.THRESHOLD).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near copies: sets of shingles of five words that share 0.8 or more."""
    return simhash.deduplicate(docs, size=5, similarity=0.8)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [kind] in place of personal data; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix says, 0 to 2 times."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the ids of every text, and whether decoding them gives the text's bytes again."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    # fewer pieces than by default, as the workers have served the stages before
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "source", common.whole_text().alias("text")), ranks, pattern, keep=KEEP), ranks, pattern, keep=KEEP)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text").cast("binary")).alias("round_trip"))


#: Pieces that a worker remembers in the last stage.
KEEP = 60_000

STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Learning, iteration and tokenization have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole documents table of sf_dir."""
    docs, path = common.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, new = common.materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
        if path:
            common.discard(spark, path)
        path = new
    return STAGES[-1][1](spark, docs, sf_dir)
