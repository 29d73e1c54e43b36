"""A corpus pipeline of five stages over ``documents``, each written and read again.

toxicity -> near-duplicates -> decontamination -> mixing -> sharding.  Each stage works
on all rows its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.llm import decontamination, mixing, near_dedup, sharding, toxicity
from scrivia.llm.common import materialise, quoted, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that score at or above the cut go."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), held_out=None, keep=docs.columns)
    return scored.where(F.col(scored.columns[-1]) < toxicity.CUT).select(*[quoted(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return near_dedup.near_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that contain a test item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as the mix serves it, to the nearest whole time; those without words stay."""
    return mixing.mixed(docs)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: the documents with the shard each belongs to."""
    return sharding.shard(docs, keep=docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]

#: The first stage learns from labels and the second searches by fingerprints: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
