"""Pre-merge activity, modes of live change sets, and plans of store merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .labels import future_coupling
from .temporal import overlapping_pairs


def recent_activity(prs: DataFrame, months: int) -> DataFrame:
    """FE01, SF08: log counts of commits and authors of the repository in the months before the merge month.

    ``prs``: (pr, repo, at, author). Activity is first added up by repository and month, and each month is dealt
    to the months whose window it falls in, so no pair of change sets is formed.
    """
    month = F.date_trunc("month", "at")
    own = prs.select("repo", month.alias("m"), "pr", F.lower("author").alias("author"))
    by_month = own.groupBy("repo", "m").agg(F.count("*").alias("n"), F.collect_set("author").alias("a"))
    later = F.explode(F.sequence(F.lit(1), F.lit(months))).alias("i")
    dealt = by_month.select("repo", "m", "n", "a", later).select("repo", (F.col("m") + F.make_ym_interval(F.lit(0), F.col("i"))).alias("m"), "n", "a")
    seen = dealt.groupBy("repo", "m").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("a")))).alias("k"))
    both = prs.withColumn("m", month).join(seen, ["repo", "m"], "left")
    log = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)))
    return both.select("pr", log("n").alias("log_commits"), log("k").alias("log_authors"))


def coupling_history(past: DataFrame, recent: DataFrame, touched: DataFrame) -> DataFrame:
    """FE01: the ten features of a sample's touched modules from the snapshots at the start of its merge month and six months
    earlier; both are (snap, module, ca, ce, in_cycle), ``touched`` is (sample, snap, module). What can't be known is 0."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    told = touched.select("sample", "snap", "module").distinct()
    total = F.col("ca") + F.col("ce")
    r = told.join(recent.select("snap", "module", total.alias("_n"), "in_cycle"), ["snap", "module"], "left")
    r = r.join(past.select("snap", "module", F.lit(True).alias("_old")), ["snap", "module"], "left")
    s = r.groupBy("sample", "snap").agg(
        zero(F.avg("_n")).alias("touched_mean_coupling"), zero(F.max("_n")).alias("touched_max_coupling"),
        (F.count_if("in_cycle") / F.count("*")).alias("touched_in_cycle_share"), (F.count_if("_old") / F.count("*")).alias("touched_existed_6_months_ago"),
    )
    repo = recent.groupBy("snap").agg(F.avg(2 * F.col("ce")).alias("_mean"), F.count("*").alias("_modules"))
    momentum = future_coupling(past, recent, touched, 0.5).select("sample", "growth", "trend", "excess", "joined")
    both = s.join(repo, "snap", "left").join(momentum, "sample", "left")
    joined = F.when(F.col("growth").isNotNull(), (F.col("joined") > 0).cast("double"))
    return both.select(
        "sample", zero(F.col("growth")).alias("past_coupling_growth"), zero(F.col("trend")).alias("past_repository_trend"), zero(F.col("excess")).alias("past_excess_growth"),
        zero(joined).alias("past_joined_cycle"), "touched_existed_6_months_ago", "touched_mean_coupling", "touched_max_coupling", "touched_in_cycle_share",
        zero(F.col("_mean")).alias("repo_mean_coupling"), zero(F.log1p("_modules")).alias("log_repo_modules"),
    )


def file_activity(sets: DataFrame, days: int = 182) -> DataFrame:
    """FE01: (pr, log_file_commits, log_file_authors, log_repo_commits) of the commits of a change's repository in the ``days``
    days before it, that touch one of its files, or at all. ``sets`` is long: (pr, repo, at, author, file)."""
    prs = sets.select("pr", "repo", "at", "author").distinct()
    pairs = overlapping_pairs(sets, "repo", "file", "pr", "at", days=days).select("earlier", F.col("later").alias("pr"))
    seen = pairs.join(prs.select(F.col("pr").alias("earlier"), F.lower("author").alias("_a")), "earlier").groupBy("pr").agg(F.count("*").alias("_n"), F.countDistinct("_a").alias("_k"))
    # Commits of a repository are counted by moment before the running window, and by day where it is hot.
    at = prs.groupBy("repo", "at").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("repo").orderBy(F.col("at").cast("timestamp").cast("long")).rangeBetween(-days * 86400, -1)
    of_repo = at.select("repo", "at", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_r"))
    both = prs.select("pr", "repo", "at").join(of_repo, ["repo", "at"]).join(seen, "pr", "left")
    log = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)))
    return both.select("pr", log("_n").alias("log_file_commits"), log("_k").alias("log_file_authors"), log("_r").alias("log_repo_commits"))


def live_mode(merged: Column, open_: Column, parents: Column) -> Column:
    """LB15: how a live change set is compared: its merge commit, its squash or rebase, its test merge, or its base."""
    return F.when(merged & (parents >= 2), "merge_commit").when(merged, "squash_or_rebase").when(open_, "open").otherwise("closed")


def merge_plan(old: DataFrame, new: DataFrame, key: str, hash_: str) -> DataFrame:
    """SX50: what a store does with each id: keep it, add it, compute it anew, or leave it as it is."""
    a = old.select(key, F.col(hash_).alias("_a"), F.lit(True).alias("_o"))
    b = new.select(key, F.col(hash_).alias("_b"), F.lit(True).alias("_n"))
    action = F.when(F.col("_n").isNull(), "keep").when(F.col("_o").isNull(), "new").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))
