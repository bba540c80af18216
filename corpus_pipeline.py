"""The corpus pipeline: documents in, mixed and sharded training text out.

Quality classifier (rejected documents go), near-duplicates (one document of each group stays),
benchmark decontamination (documents with a benchmark passage go), mixing to target weights (a
row per document and pass, with the words taken), and sharding (shard and slot of each row).
Each stage is written and read again before the next one starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veinlode.llm import decontaminate, mixing, neardup, quality, sharding
from veinlode.llm.common import materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SHARDS = 8


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learnt = table(spark, sf_dir, "labels").where(~quality.held_out("doc_id"))
    return quality.keep_good(docs, learnt)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_duplicates(docs, size=2)  # the shingles of the operator's contract


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_texts(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, dict.fromkeys(range(SHARDS), 1.0))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("neardup", unique),
    ("decontaminate", clean),
    ("mix", mixed),
    ("shard", sharded),
]
#: Trained vectors, sketches and pseudorandom draws have no SQL form; the operators' tests hold each stage's work against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
