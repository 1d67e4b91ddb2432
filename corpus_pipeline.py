"""From documents to shards: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of documents; the
last adds each document's place.

Defined cases: a null or empty text is clean, has no near-duplicates and no passages, and is kept or dropped by mixing
with its cell; of repeated rows one stays; rows with a null id go through every stage; texts of any length are treated
whole; an empty table of documents gives no rows, an empty benchmark drops nothing, without labels no document is
toxic; further columns, whatever their names, pass through, but for shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontaminate, mixing, near, shards, toxicity
from leafmill.llm.common import fold, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier finds toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, model)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample a stated share of the tokens so that sources, languages and topics meet their target shares."""
    return mixing.mix(docs, share=mixing.SHARE)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document in a shard, with its slot there."""
    return shards.place(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near-dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = written(out, f"stage-{name}") if i < len(STAGES) - 1 else out
    return docs


#: A classifier that is trained here and hashes of 64 bits have no counterpart in SQL; tests/llm has the comparison.
ORACLE_SQL = None
