"""Joins and windows over time. None compares all pairs of a group: each is an equi-join, a window, or a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .places import carried, numbered, running


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """JN06: each left row with the values of the latest right row of its key at or before it; null if there is none.

    Both sides go into one sorted run, so the work is n log n, not a range join, and a hot key's run is spread over ranges.
    ``right`` has (key, at, *values); of right rows at one time the one with the greatest values wins.
    """
    l = left.withColumn("_row", F.struct(*left.columns)).select(key, F.col(at).alias("_t"), F.lit(1).alias("_side"), "_row", F.lit(None).alias("_v"))
    r = right.select(key, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.struct(*values).alias("_v"))
    both = l.drop("_v").unionByName(r.drop("_row"), allowMissingColumns=True)
    seen = carried(both, [key], ["_t", "_side", "_v"], "_v", "_found").where("_side = 1")
    return seen.select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def overlapping_pairs(sets: DataFrame, group: str, item: str, key: str, at: str, months: int = 0, days: int = 0) -> DataFrame:
    """JN07: (earlier, later, shared) pairs of one group with start < later <= start + months (or days) and common items.

    ``sets`` is long: (group, key, at, item). Earlier rows are listed in the months of their horizon, later ones lie in
    one, and the join is on (group, item, month): rows of a hot item that are out of reach never meet.
    """
    rows = sets.select(group, key, at, item).distinct()
    month = lambda c: F.year(c) * 12 + F.month(c)
    span = months if months else days // 28 + 1
    far = F.col("_a") + (F.make_ym_interval(F.lit(0), F.lit(months)) if months else F.make_dt_interval(F.lit(days)))
    a = rows.select(group, item, F.col(key).alias("earlier"), F.col(at).alias("_a"), F.explode(F.sequence(month(at), month(at) + span)).alias("_month"))
    b = rows.select(group, item, F.col(key).alias("later"), F.col(at).alias("_b"), month(at).alias("_month"))
    near = a.join(b, [group, item, "_month"]).where((F.col("_b") > F.col("_a")) & (F.col("_b") <= far))
    return near.groupBy("earlier", "later").agg(F.count("*").alias("shared"))


def interval_overlap(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """JN09: rows of both sides with a common point, [start, end] against [low, high], of one key.

    Intervals are listed in cells of ``width`` and joined by cell; a pair is taken in the first cell that both have.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))).alias("_cell")
    l = left.select("*", cells("start", "end"))
    r = right.select("*", cells("low", "high"))
    both = l.join(r, [key, "_cell"]).where("start <= high AND low <= end")
    return both.where(F.col("_cell") == F.floor(F.greatest("start", "low") / width)).drop("_cell")


def trailing_count(rows: DataFrame, key: str, at: str, days: int, name: str) -> DataFrame:
    """ST07, FE11: rows of the key in the ``days`` days up to and including each row; null without a time.

    The rows up to each second are summed over ranges, and those before the days are looked up, so a hot key isn't in one task.
    """
    second = F.col(at).cast("long")
    ticks = rows.where(F.col(at).isNotNull()).groupBy(key, second.alias("_s")).agg(F.count("*").alias("_k"))
    sums = running(ticks, [key], ["_s"], "_k", "_c").drop("_k")
    asked = sums.withColumn("_t", F.col("_s") - days * 86400 - 1)
    both = as_of(asked, sums.select(key, F.col("_s").alias("_t"), F.col("_c").alias("_old")), key, "_t", ["_old"])
    counts = both.select(F.col(key).alias("_key"), "_s", (F.col("_c") - F.coalesce("_old", F.lit(0))).alias(name))
    return rows.join(counts, F.col(key).eqNullSafe(F.col("_key")) & (second == F.col("_s")), "left").drop("_key", "_s")


def ranked_cut(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """WN05: the first ``k`` rows of each group; ``order`` must be total."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def nearest_rank(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """WN08: the value at place ceil(share * n) of each group."""
    placed = numbered(rows.select(*by, value), by, [value])
    return placed.where(F.col("_p") + 1 == F.ceil(F.col("_n") * share)).select(*by, F.col(value).alias("cutoff"))


def evenly(rows: DataFrame, by: list[str], order: list[str], count: int) -> DataFrame:
    """WN03: ``count`` rows of each group spread over its order, at places floor(i * n / count); all if there are fewer."""
    at = numbered(rows, by, order)
    # Place p is floor(i * n / count) for some i just where the floor of p * count / n, rounded up, leads back to it.
    i = F.ceil(F.col("_p") * F.lit(count) / F.col("_n"))
    hit = (F.floor(i * F.col("_n") / F.lit(count)) == F.col("_p")) & (i < count)
    return at.where((F.col("_n") <= count) | hit).drop("_n", "_p")


def chronological_cutoffs(rows: DataFrame, by: str, at: str, shares: tuple[float, float]) -> DataFrame:
    """WN02, SP06: per group the times at places min(n - 2, max(1, ceil(n * first))) and the like for the second share."""
    placed = numbered(rows.select(by, at), [by], [at])
    place = lambda share, least: F.least(F.col("_n") - 1, F.greatest(F.lit(least), F.ceil(F.col("_n") * share)))
    one = F.least(F.col("_n") - 2, F.greatest(F.lit(1), F.ceil(F.col("_n") * shares[0])))
    pick = lambda p: F.max(F.when(F.col("_p") == p, F.col(at)))
    return placed.where("_n >= 3").groupBy(by).agg(pick(one).alias("train_cutoff"), pick(place(shares[1], 2)).alias("validation_cutoff"))
