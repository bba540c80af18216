"""The queries ``opN_<name>``: each applies one operator to its whole table and returns the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, links, mixing, neardup, pii, preferences, quality, rules, sharding, tokens
from .common import table
from .oracle import ORACLES

TOKENIZER = "byte_bpe_50k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.digest(table(spark, sf_dir, "pages"))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.digest(table(spark, sf_dir, "conversations"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(table(spark, sf_dir, "documents"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        return tokens.digest(table(spark, sf_dir, "documents"), f.read())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_pii,
        op2_quality,
        op3_links,
        op4_preferences,
        op5_decontaminate,
        op6_shard,
        op7_rules,
        op8_neardup,
        op9_mix,
        op10_tokens,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
