"""Connected components by alternating large-star and small-star steps, all in DataFrame joins.

A hub's smallest neighbour comes from a partial aggregation, and the join that
brings it back to the links is a plain sort-merge join. That join shares its exchange with the aggregation,
so the links of a hub still meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def least_neighbour(links: DataFrame) -> DataFrame:
    """Links (u, v) with ``m``, the smallest v of each u."""
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")


def large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = least_neighbour(both).where(F.col("v") > F.col("u"))
    return near.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    near = least_neighbour(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return (
        near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes in ``links`` (u, v): the component is its smallest node.

    Rounds end when nothing changes; their number grows with the logarithm of a component's size, so
    ``max_rounds`` is a guard against errors, and reaching it raises.
    """
    links = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = None
    for _ in range(max_rounds):
        links = materialise(small_star(large_star(links)))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = tuple(now)
    raise RuntimeError(f"components still change after {max_rounds} rounds")
