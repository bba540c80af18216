"""Splits of samples, and the checks that they don't leak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import numbered, running


def temporal_split(merged: Column, horizon: Column, first: Column, second: Column) -> Column:
    """SP01: train if the horizon ends by the first cutoff, validation between the two, test from the second on; else purged."""
    return (
        F.when(horizon <= first, "train")
        .when((merged >= first) & (horizon <= second), "validation")
        .when(merged >= second, "test")
        .otherwise("purged")
    )


def crossing_groups(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """SO06, SP03: groups that lie in more than one split (purged rows aside)."""
    found = rows.where(F.col(split) != "purged").groupBy(group).agg(F.countDistinct(split).alias("splits"))
    return found.where("splits > 1")


def hash_order(key: Column, seed: str) -> Column:
    """SP05: the order of groups: sha256 of seed:key."""
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)


def greedy_split(sizes: DataFrame, group: str, size: str, seed: str, test: float, validation: float) -> DataFrame:
    """WN04, SP05: groups in hash order fill test until it has its share, then validation, then train.

    A group goes to test while the rows before it are below the target; validation fills in the same way from
    the groups that test leaves. Test is a run from the start of the order, so what lies before a group of the rest is
    the running sum less all of test. Sums run over ranges of groups.
    """
    sums = running(sizes.withColumn("_h", hash_order(F.col(group), seed)), [], ["_h", group], size, "_c")
    before = F.col("_c") - F.coalesce(F.col(size), F.lit(0))
    a = sums.crossJoin(sizes.agg(F.sum(size).alias("_all"))).withColumn("_test", before < F.col("_all") * test)  # one row of totals
    a = a.crossJoin(a.agg(F.coalesce(F.sum(F.when(F.col("_test"), F.col(size))), F.lit(0)).alias("_taken")))
    split = F.when(F.col("_test"), "test").when(before - F.col("_taken") < F.col("_all") * validation, "validation").otherwise("train")
    return a.select(group, size, split.alias("split"))


def stratified_split(rows: DataFrame, key: str, label: str, seed: str, shares: tuple[float, float]) -> DataFrame:
    """SP07: train, validation and test by rank in hash order within each label."""
    place = F.col("_p") / F.col("_n")
    split = F.when(place < shares[0], "train").when(place < shares[0] + shares[1], "validation").otherwise("test")
    return numbered(rows, [label], [hash_order(F.col(key), seed), key]).withColumn("split", split).drop("_p", "_n")


def cohort_report(rows: DataFrame, split: str, repo: str, label: str) -> DataFrame:
    """AG08, SP04: safe, risky and all rows by split and repository, with totals."""
    return rows.rollup(split, repo).agg(
        F.count_if(F.col(label) == 0).alias("safe"), F.count_if(F.col(label) == 1).alias("risky"), F.count("*").alias("total")
    )


def cohort_violations(rows: DataFrame, split: str, repo: str, label: str, least_class: int, least_repos: int) -> DataFrame:
    """SP04: (split, problem) of splits with too few rows of a class, or too few repositories."""
    s = rows.groupBy(split).agg(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b"), F.countDistinct(repo).alias("r"))
    found = F.array_compact(F.array(F.when(F.least("a", "b") < least_class, "class"), F.when(F.col("r") < least_repos, "repositories")))
    return s.select(split, F.explode(found).alias("problem"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """SX12: keys that occur more than once, with their count."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def alignment_problems(a: DataFrame, b: DataFrame, key: str, same: list[str]) -> DataFrame:
    """SP08, JN01, XR22: (key, problem): missing on a side, or another value in one of ``same``."""
    left = a.select(key, F.struct(*same).alias("_a"))
    right = b.select(key, F.struct(*same).alias("_b"))
    both = left.join(right, key, "full_outer")
    differs = [F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in same]
    found = F.when(F.col("_a").isNull(), F.array(F.lit("missing_left"))).when(F.col("_b").isNull(), F.array(F.lit("missing_right"))).otherwise(F.array_compact(F.array(*differs)))
    return both.select(key, F.explode(found).alias("problem"))


def batches(rows: DataFrame, split: str, order: str, size: int) -> DataFrame:
    """WN12: batch numbers of at most ``size`` rows that never mix splits."""
    return numbered(rows, [split], [order]).withColumn("batch", F.floor(F.col("_p") / size).cast("long")).drop("_p", "_n")


def split_by_repository(rows: DataFrame, cutoffs: DataFrame, repo: str) -> DataFrame:
    """SP02: rows (repo, at, horizon_end) with the split that their repository's cutoffs (repo, train_cutoff,
    validation_cutoff) give them; repositories without cutoffs have none and are left out."""
    both = rows.join(cutoffs, repo)
    split = temporal_split(F.col("at"), F.col("horizon_end"), F.col("train_cutoff"), F.col("validation_cutoff"))
    return both.withColumn("split", split).drop("train_cutoff", "validation_cutoff")


def cover_problems(splits: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """SP09: (key, problem) where given splits (key, split) aren't disjoint, or don't cover the known ids just so."""
    a = splits.groupBy(key).agg(F.count("*").alias("_n"))
    b = known.select(key).distinct().withColumn("_k", F.lit(True))
    both = a.join(b, key, "full_outer")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_k").isNull(), "unknown").when(F.col("_n") > 1, "twice")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def balanced_pick(rows: DataFrame, label: str, key: str, seed: str, n: int) -> DataFrame:
    """SP10, WN07: the ``n`` rows of each class that come first in hash order; ``n`` is the size of the wanted test set."""
    from .temporal import ranked_cut

    return ranked_cut(rows, [label], [hash_order(F.col(key), seed), F.asc(key)], n)
