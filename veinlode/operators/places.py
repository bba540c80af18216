"""Places of rows in the order of their group, without a task that holds a whole group.

Rows are dealt by ranges of (group, order), sorted within a range and written in the shared folder, so a group of any size is
spread over ranges. A row's place then is the number of rows of its group in earlier ranges, known from one row per
group and range, and its distance from the group's first row in its own range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut


def ranged(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``rows`` written in the order of (by, order), with ``_id``, which grows along it, and ``_range``. Rows that are alike in
    both are put in any order, and may lie in different ranges."""
    tied = rows.withColumn("_tie", F.rand(0))
    run = [*by, *order, "_tie"]
    done = tied.repartitionByRange(*run).sortWithinPartitions(*run).withColumn("_id", F.monotonically_increasing_id())
    return cut(done.drop("_tie").withColumn("_range", F.shiftright("_id", 33)))


def with_sums(rows: DataFrame, sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each ranged row with what is known of its group and range; null groups meet too."""
    named = sums.withColumnsRenamed({b: f"_by_{i}" for i, b in enumerate(by)} | {"_range": "_by_range"})
    same = F.col("_range") == F.col("_by_range")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{i}"))
    return rows.join(named, same).drop(*[f"_by_{i}" for i in range(len(by))], "_by_range")


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], place: str = "_p", total: str = "_n") -> DataFrame:
    """``rows`` with their ``place`` in their group, from 0, and the group's ``total`` of rows."""
    sorted_rows = ranged(rows, by, order)
    group = Window.partitionBy(*by)  # over a row per range
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sorted_rows.groupBy(*by, "_range").agg(F.count("*").alias("_k"), F.min("_id").alias("_first"))
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_k").over(before), F.lit(0)), total: F.sum("_k").over(group)}).drop("_k")
    return with_sums(sorted_rows, sums, by).withColumn(place, F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_range", "_first", "_before")


def carried(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the last ``value`` that isn't null up to each row in the order of its group."""
    sorted_rows = ranged(rows, by, order)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    ends = sorted_rows.groupBy(*by, "_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_id"))).alias("_end"))
    ends = ends.withColumn("_start", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    inside = Window.partitionBy(*by, "_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    own = with_sums(sorted_rows, ends, by).withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_start"))
    return own.drop("_id", "_range", "_start")


def running(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` up to and including each row in the order of its group."""
    sorted_rows = ranged(rows, by, order)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    sums = sorted_rows.groupBy(*by, "_range").agg(F.sum(value).alias("_all"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0))).drop("_all")
    inside = Window.partitionBy(*by, "_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    return with_sums(sorted_rows, sums, by).withColumn(name, F.sum(value).over(inside) + F.col("_before")).drop("_id", "_range", "_before")
