"""Joins, set operations and small aggregations that the larger operators are built from, over any tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.store import write_tables


def lookup(rows: DataFrame, other: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """JN01: rows that the other side knows, with its values."""
    return rows.join(other.select(key, *values), key)


def with_default(rows: DataFrame, other: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """JN02: every row, with the other side's values, or the default where it has none."""
    return rows.join(other.select(key, *defaults), key, "left").select(*rows.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def reconciled(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JN03: (key, state) of the keys of both sides: both, left or right."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    state = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return left.join(right, key, "full_outer").select(key, state.alias("state"))


def among(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """JN04: rows whose key is chosen."""
    return rows.join(chosen.select(key), key, "left_semi").select(*rows.columns)


def absent(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """JN05: rows whose key isn't done yet."""
    return rows.join(done.select(key), key, "left_anti").select(*rows.columns)


def grid(rows: DataFrame, name: str, values: Sequence) -> DataFrame:
    """JN12: each row with each of a few given values, in place."""
    return rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """AG01: rows of each group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def any_of(array: Column, test) -> Column:
    """AG03: whether one element passes; false for null and empty arrays."""
    return F.coalesce(F.exists(array, test), F.lit(False))


def every_of(array: Column, test) -> Column:
    """AG03: whether all elements pass; true for null and empty arrays."""
    return F.coalesce(F.forall(array, test), F.lit(True))


def distinct_logs(rows: DataFrame, by: str, names: dict[str, Column]) -> DataFrame:
    """AG05: log of one and the number of distinct values, per group."""
    return rows.groupBy(by).agg(*[F.log1p(F.countDistinct(v)).alias(n) for n, v in names.items()])


def over_seeds(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """AG11, AG12: mean and population deviation of a value over the runs of each group, and their number."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.count("*").alias("runs"))


def united(*parts: DataFrame) -> DataFrame:
    """SO01: distinct rows of all parts, by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def differences(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SO02: the rows of one side only, with ``side`` added or removed."""
    added = after.select(*keys).distinct().join(before.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("added"))
    removed = before.select(*keys).distinct().join(after.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("removed"))
    return added.unionByName(removed)


def kept(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SO03: the rows that both sides have."""
    return after.select(*keys).distinct().join(before.select(*keys), list(keys), "left_semi")


def overlap(a: DataFrame, b: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """SO04, SO07: per group the Jaccard distance of two sets of items (0 if both are empty), and their positive
    specific agreement 2 |A and B| / (|A| + |B|), null if both are empty."""
    left = a.select(*by, item).distinct().withColumn("_a", F.lit(1))
    right = b.select(*by, item).distinct().withColumn("_b", F.lit(1))
    s = left.join(right, [*by, item], "full_outer").groupBy(*by).agg(F.sum(F.col("_a") * F.col("_b")).alias("_k"), F.sum("_a").alias("_x"), F.sum("_b").alias("_y"))
    k, x, y = (F.coalesce(c, F.lit(0)) for c in ("_k", "_x", "_y"))
    return s.select(*by, (1 - ratio(k, x + y - k, 1.0)).alias("distance"), ratio(2 * k, x + y, None).alias("agreement"))


def outside(rows: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SO05: rows that break the claim that all of them are allowed."""
    return rows.select(*keys).distinct().join(allowed.select(*keys), list(keys), "left_anti")


def write_graph(before: DataFrame, after: DataFrame, keys: Sequence[str], touched: DataFrame, root: str) -> dict[str, DataFrame]:
    """SX03: a sample's later graph, its added and removed edges, and one row of counts, written below ``root``.

    ``touched`` has the changed nodes as ``node``; an edge counts as touched if either of the first two keys is one.
    """
    a, b = keys[:2]
    ends = touched.select("node").distinct()
    near = after.join(ends.withColumnRenamed("node", "_a").withColumn("_x", F.lit(True)), F.col(a) == F.col("_a"), "left").join(ends.withColumnRenamed("node", "_b").withColumn("_y", F.lit(True)), F.col(b) == F.col("_b"), "left")
    graph = near.withColumn("touched", F.coalesce("_x", "_y", F.lit(False))).drop("_a", "_b", "_x", "_y")
    done = write_tables(root, graph=graph, delta=differences(before, after, keys))
    sides = done["delta"].agg(F.count_if(F.col("side") == "added").alias("added"), F.count_if(F.col("side") == "removed").alias("removed"))
    counts = done["graph"].agg(F.count("*").alias("edges"), F.count_if("touched").alias("touched")).crossJoin(sides)  # one row each
    return done | write_tables(root, metrics=counts)
