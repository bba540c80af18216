"""Repository-history entities as views over the supplied tables, in Spark and in DuckDB.

A supplier is a module, an order a change set of its customer's repository, and a part a file. A
dependency of a snapshot year runs between suppliers of one order whose lines are both large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import table

LARGE = 46


def modules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("module"))


def edges(spark: SparkSession, d: str, year: int | None = None) -> DataFrame:
    """(src, dst, relation[, year]); all years where none is named."""
    lines = table(spark, d, "lineitem").where(F.col("l_quantity") >= LARGE)
    a = lines.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("src"), F.year("l_shipdate").alias("year"), F.concat("l_returnflag", "l_linestatus").alias("relation"))
    b = lines.select("l_orderkey", F.col("l_linenumber").alias("m"), F.col("l_suppkey").alias("dst"))
    if year is not None:
        a = a.where(F.col("year") == year)
    found = a.join(b, "l_orderkey").where("m > n AND src <> dst")
    keys = ["src", "dst", "relation"] if year is not None else ["src", "dst", "relation", "year"]
    return found.select(*keys).distinct()


def plain(spark: SparkSession, d: str, year: int) -> DataFrame:
    return edges(spark, d, year).select("src", "dst").distinct()


EDGES = f"""edges AS (
    SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst, a.l_returnflag || a.l_linestatus AS relation, year(a.l_shipdate) AS year
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > a.l_linenumber
    WHERE a.l_quantity >= {LARGE} AND b.l_quantity >= {LARGE} AND a.l_suppkey <> b.l_suppkey)"""


def sql_edges(name: str, year: int) -> str:
    return f"{name} AS (SELECT DISTINCT src, dst FROM edges WHERE year = {year})"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, split, label, score): quality labels, and a coarse score with many ties."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    z = (F.col("n_chars") - 1500) / 1000.0
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("sample_id"),
        F.col("lang").alias("split"),
        F.col("quality").alias("label"),
        F.round(1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(20.0)), F.lit(-20.0)))), 2).alias("score"),
    )


PREDICTIONS = """p AS (
    SELECT d.doc_id AS sample_id, lang AS split, quality AS label,
           round(1 / (1 + exp(-greatest(least((n_chars - 1500) / 1000.0::DOUBLE, 20.0::DOUBLE), -20.0::DOUBLE))), 2) AS score
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
