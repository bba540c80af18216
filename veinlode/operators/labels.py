"""Outcome labels and protocol checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import matched_keywords
from .lineage import is_match, is_settled


def future_coupling(at_merge: DataFrame, future: DataFrame, touched: DataFrame, threshold: float) -> DataFrame:
    """LB01: (sample, growth, trend, excess, joined, label, reason) of each sample of ``touched`` (sample, snap, module).

    ``at_merge``, ``future``: (snap, module, ca, ce, in_cycle), all modules of two snapshots of a repository; samples may
    share them. Growth is the mean change of the couplings of the touched modules that both snapshots have; the trend is
    the difference of the snapshots' mean couplings (two ends per edge), over all modules of each. The label is 1 if a touched module has
    joined a cycle, or the growth above the trend exceeds the threshold; without a touched module in both it is null.
    """
    total = F.col("ca") + F.col("ce")
    mean = lambda df, name: df.groupBy("snap").agg(F.avg(2 * F.col("ce")).alias(name))
    side = lambda df, t, c: df.select("snap", "module", total.alias(t), F.col("in_cycle").alias(c))
    told = touched.select("sample", "snap", "module").distinct()
    both = told.join(side(at_merge, "_a", "_ca"), ["snap", "module"]).join(side(future, "_b", "_cb"), ["snap", "module"])
    g = both.groupBy("sample").agg(F.avg(F.col("_b") - F.col("_a")).alias("growth"), F.count_if(F.col("_cb") & ~F.col("_ca")).alias("joined"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    s = told.select("sample", "snap").distinct().join(g, "sample", "left").join(mean(at_merge, "_m"), "snap", "left").join(mean(future, "_f"), "snap", "left")
    s = s.withColumn("trend", F.when(F.col("growth").isNotNull(), zero("_f") - zero("_m"))).withColumn("excess", F.col("growth") - F.col("trend"))
    reason = (
        F.when(F.col("growth").isNull(), "touched_modules_missing_in_future")
        .when(F.col("joined") > 0, "joined_new_cycle")
        .when(F.col("excess") > threshold, "excess_coupling_growth")
        .otherwise("no_degradation")
    )
    label = F.when(F.col("growth").isNotNull(), reason.isin("joined_new_cycle", "excess_coupling_growth").cast("int"))
    return s.select("sample", "growth", "trend", "excess", F.coalesce("joined", F.lit(0)).alias("joined"), label.alias("label"), reason.alias("reason"))


def new_cycles(before: DataFrame, after: DataFrame, touched: DataFrame) -> DataFrame:
    """LB02: (component, members) of the later snapshot's cycles that the earlier one hasn't with just the same members,
    and that a touched module (module) lies in. Both sides are (module, component); the label is whether there is a row."""
    sets = lambda df: df.groupBy("component").agg(F.array_sort(F.collect_set("module")).alias("members"))
    fresh = sets(after).join(sets(before).select("members"), "members", "left_anti")
    hit = after.join(touched.select("module").distinct(), "module", "left_semi").select("component").distinct()
    return fresh.join(hit, "component", "left_semi").select("component", "members")


def title_events(records: DataFrame, keywords: list[str], title: str = "title") -> DataFrame:
    """LB04: records whose title alone has a keyword: candidates for a review, not events yet."""
    return records.where(F.size(matched_keywords(F.col(title), keywords)) > 0)


def within_horizon(samples: DataFrame, events: DataFrame, key: str, months: int) -> DataFrame:
    """JN08: (sample_id, event_id, event_at) of the events of the sample's key in (at, at + months].

    Samples are listed in the months of their horizon, events lie in one; the join is on key and month, so that events
    out of reach never meet a sample, and a hot key is spread over its months.
    """
    month = lambda ts: F.year(ts) * 12 + F.month(ts)
    s = samples.select("sample_id", key, "at", F.explode(F.sequence(month(F.col("at")), month(F.col("at")) + months)).alias("_month"))
    e = events.select("event_id", key, "event_at", month(F.col("event_at")).alias("_month"))
    inside = (F.col("event_at") > F.col("at")) & (F.col("event_at") <= F.col("at") + F.make_ym_interval(F.lit(0), F.lit(months)))
    return s.join(e, [key, "_month"]).where(inside).select("sample_id", "event_id", "event_at")


def future_outcomes(
    samples: DataFrame, events: DataFrame, files: DataFrame, windows: DataFrame, matches: DataFrame, excluded: DataFrame, failed: DataFrame, months: int
) -> DataFrame:
    """LB03: (sample_id, status, label, event_id, unresolved): each sample's outcome within its horizon.

    ``samples``: (sample_id, repo, at). ``events``: (event_id, repo, event_at, reviewed): reviewed ones are confirmed
    refactorings, others unresolved. ``files``: (sample_id, path), production files that a sample changed. ``windows``:
    (repo, observed_from, observed_until). ``matches``: (sample_id, event_id, status, matched), as ``lineage.match``
    gives them. ``excluded``, ``failed``: (sample_id) of changes without substance, and of those that couldn't be read.

    Both classes need the same full follow-up, so censoring comes before any event. Statuses in order:
    invalid_metadata, excluded_non_substantive_change, excluded_no_python_files, unverified_coverage, censored,
    incomplete_sample_history, unverified_lineage (no match was tried), labelled 1 (the earliest reviewed event that
    shares a file), unreviewed_outcome (an unresolved event shares one), unverified_followup_history (of some event it
    isn't known), labelled 0.
    """
    horizon = F.col("at") + F.make_ym_interval(F.lit(0), F.lit(months))
    flag = lambda df, name: df.select("sample_id").distinct().withColumn(name, F.lit(True))
    s = samples.join(flag(excluded, "_out"), "sample_id", "left").join(flag(files, "_files"), "sample_id", "left").join(windows, "repo", "left")
    s = s.join(flag(failed, "_failed"), "sample_id", "left").join(flag(matches, "_tried"), "sample_id", "left")
    early = (
        F.when(F.col("repo").isNull() | F.col("at").isNull(), "invalid_metadata")
        .when(F.col("_out"), "excluded_non_substantive_change")
        .when(F.col("_files").isNull(), "excluded_no_python_files")
        .when(F.col("observed_from").isNull(), "unverified_coverage")
        .when((F.col("at") < F.col("observed_from")) | (horizon > F.col("observed_until")), "censored")
        .when(F.col("_failed"), "incomplete_sample_history")
        .when(F.col("_tried").isNull(), "unverified_lineage")
    )
    s = s.select("sample_id", "repo", "at", early.alias("_early"))
    near = within_horizon(s.where("_early IS NULL"), events, "repo", months).join(events.select("event_id", "reviewed"), "event_id")
    found = near.join(matches, ["sample_id", "event_id"], "left")
    hit, settled = is_match(F.col("status"), F.col("matched")), is_settled(F.col("status"))
    order = F.struct("event_at", "event_id")
    s2 = found.groupBy("sample_id").agg(
        F.min(F.when(F.col("reviewed") & hit, order)).alias("_event"),
        F.array_sort(F.collect_set(F.when(~F.col("reviewed") & hit, F.col("event_id")))).alias("_open"),
        F.array_sort(F.collect_set(F.when(~settled, F.col("event_id")))).alias("_unknown"),
    )
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    late = F.when(F.col("_event").isNotNull(), "labelled").when(some("_open"), "unreviewed_outcome").when(some("_unknown"), "unverified_followup_history").otherwise("labelled")
    done = s.join(s2, "sample_id", "left").withColumn("status", F.coalesce("_early", late))
    label = F.when(F.col("status") == "labelled", F.col("_event").isNotNull().cast("int"))
    open_ = F.when(F.col("status") == "unreviewed_outcome", F.col("_open")).when(F.col("status") == "unverified_followup_history", F.col("_unknown"))
    return done.select("sample_id", "status", label.alias("label"), F.col("_event.event_id").alias("event_id"), open_.alias("unresolved"))


def first_outcome(samples: DataFrame, events: DataFrame, ends: DataFrame, key: str, months: int) -> DataFrame:
    """JN10, ST06: (sample_id, status, event_id, label) where every event counts and only the end of observation is known.

    ``ends``: (key, observed_until). A sample whose horizon isn't wholly observed is censored, with an event or without.
    """
    first = within_horizon(samples, events, key, months).groupBy("sample_id").agg(F.min(F.struct("event_at", "event_id")).alias("_e"))
    both = samples.join(first, "sample_id", "left").join(ends, key, "left")
    horizon = F.col("at") + F.make_ym_interval(F.lit(0), F.lit(months))
    status = F.when(F.col("at").isNull(), "invalid_time").when(F.col("observed_until").isNull(), "no_coverage").when(F.col("observed_until") < horizon, "censored").otherwise("labelled")
    known = status == "labelled"
    return both.select("sample_id", status.alias("status"), F.when(known, F.col("_e.event_id")).alias("event_id"), F.when(known, F.col("_e").isNotNull().cast("int")).alias("label"))


def boundary_status(parents: Column, first_parent_is_base: Column, commits: Column) -> Column:
    """LB08: how a change set's start is known, from its number of parents and commits."""
    return (
        F.when(parents.isNull() | (parents == 0), "missing")
        .when(parents >= 2, "merge")
        .when((parents == 1) & (commits == 1), "single")
        .when((parents == 1) & F.coalesce(first_parent_is_base, F.lit(False)), "squash")
        .otherwise("ambiguous")
    )


def coverage_violations(collected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """LB05, JN03: ids on one side only, with the side that lacks them."""
    a = collected.select(key).distinct().withColumn("_a", F.lit(True))
    b = stored.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer").where("_a IS NULL OR _b IS NULL")
    return both.select(key, F.when(F.col("_a").isNull(), "not_collected").otherwise("not_stored").alias("problem"))


def review_violations(reviews: DataFrame, decisions: list[str]) -> DataFrame:
    """LB06: (sample_id, problem) of reviews with an unknown decision, no evidence, or files outside the change."""
    problems = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("decision").isin(decisions), F.lit(False)), "decision"),
            F.when(F.coalesce(F.size("evidence"), F.lit(0)) == 0, "evidence"),
            F.when(F.size(F.array_except("files", "changed")) > 0, "files"),
        )
    )
    return reviews.select("sample_id", F.explode(problems).alias("problem"))


def blocker_queue(blocked: DataFrame, evidence: DataFrame) -> DataFrame:
    """LB10, WN09: unresolved events by how many samples they block, then time, then id.

    ``blocked``: (sample_id, unresolved: array of ids); ``evidence``: (event_id, merged_at).
    """
    counts = blocked.select(F.explode(F.array_distinct("unresolved")).alias("event_id")).groupBy("event_id").agg(F.count("*").alias("blocks"))
    return counts.join(evidence, "event_id", "left").orderBy(F.desc("blocks"), F.asc("merged_at"), "event_id")


def placed(queue: DataFrame) -> DataFrame:
    """WN09: the blocker queue with ``place`` from 1 on. A row per unresolved event: the places of equal counts are found
    within them, behind the total of the larger counts, so no task sorts the whole queue."""
    by = Window.partitionBy("blocks").orderBy(F.asc("merged_at"), "event_id")
    before = Window.orderBy(F.desc("blocks")).rowsBetween(Window.unboundedPreceding, -1)  # one row per distinct count
    sums = queue.groupBy("blocks").agg(F.count("*").alias("_n")).select("blocks", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return queue.join(sums, "blocks").withColumn("place", F.row_number().over(by) + F.col("_before")).drop("_before")


def listed(rows: DataFrame, explained: Column, test: Column, score: str, key: str) -> DataFrame:
    """FL15: rows with ``place``: explained ones first, then those of the test split, then by falling score, then by key. Places
    are numbered within a score of a class, behind the rows before it."""
    c = rows.withColumns({"_e": F.coalesce(explained, F.lit(False)), "_t": F.coalesce(test, F.lit(False))})
    of = ["_e", "_t", score]
    before = Window.orderBy(F.desc("_e"), F.desc("_t"), F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)  # a row per distinct score
    sums = c.groupBy(*of).agg(F.count("*").alias("_n")).select(*of, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return c.join(sums, of).withColumn("place", F.row_number().over(Window.partitionBy(*of).orderBy(key)) + F.col("_before")).drop("_e", "_t", "_before")


def view_filter(rows: DataFrame, splits: list[str] | None = None, flagged: bool | None = None, title_part: str = "", threshold: float = 0.5) -> DataFrame:
    """FL18: rows of some splits, on one side of the threshold, whose title has a part, without case; None and "" take all."""
    out = rows if splits is None else rows.where(F.col("split").isin(splits))
    out = out if flagged is None else out.where((F.col("score") >= threshold) == F.lit(flagged))
    return out if not title_part else out.where(F.lower("title").contains(title_part.lower()))


def without_executable_change(changes: DataFrame) -> DataFrame:
    """LB09: (sample_id) of the change sets whose files all are modified in place, and have the same executable syntax tree
    before and after. ``changes``: (sample_id, status, before_path, after_path, before_hash, after_hash)."""
    same = (F.col("status") == "M") & (F.col("before_path") == F.col("after_path")) & (F.col("before_hash") == F.col("after_hash"))
    return changes.groupBy("sample_id").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("_same")).where("_same").select("sample_id")
