"""JN13, LB07: whether a later event touches what a sample left behind, along one line of first parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match(pairs: DataFrame, commits: DataFrame, records: DataFrame, surviving: DataFrame, event_files: DataFrame, structural: DataFrame) -> DataFrame:
    """JN13: (sample_id, event_id, status, matched) of each pair.

    ``pairs``: (sample_id, event_id). ``records``: (pr_id, sha, before_sha, verified) of samples and events alike.
    ``commits``: (sha, line, place, reaches), every commit with its line of first parents, its place there (0 the
    oldest), and of each other line the highest place that it reaches (map line to place; its own with its own place).
    ``surviving``: (sample_id, path) a sample left behind. ``event_files``: (event_id, path). ``structural``: (line,
    place, path) of paths that a commit adds, deletes or renames.

    In this order: unknown_lineage (a commit isn't known), unrelated_lineage (the event's base doesn't reach the
    sample), unverified_boundary, nonlinear_file_history (it does, but not along first parents),
    uncertain_file_identity (a commit between renames, adds or deletes a surviving path), verified.
    """
    own = records.select(F.col("pr_id").alias("sample_id"), F.col("sha").alias("_s"), F.col("verified").alias("_sv"))
    event = records.select(F.col("pr_id").alias("event_id"), F.col("before_sha").alias("_b"), F.col("verified").alias("_ev"))
    at = commits.select(F.col("sha").alias("_s"), F.col("line").alias("_sl"), F.col("place").alias("_sp"))
    base = commits.select(F.col("sha").alias("_b"), F.col("line").alias("_bl"), F.col("place").alias("_bp"), F.col("reaches").alias("_r"))
    p = pairs.join(own, "sample_id", "left").join(event, "event_id", "left").join(at, "_s", "left").join(base, "_b", "left")
    reached = F.coalesce(F.try_element_at("_r", F.col("_sl")) >= F.col("_sp"), F.lit(False))
    straight = (F.col("_sl") == F.col("_bl")) & (F.col("_sp") <= F.col("_bp"))
    early = (
        F.when(F.col("_sl").isNull() | F.col("_bl").isNull(), "unknown_lineage")
        .when(~reached, "unrelated_lineage")
        .when(~(F.coalesce("_sv", F.lit(False)) & F.coalesce("_ev", F.lit(False))), "unverified_boundary")
        .when(~straight, "nonlinear_file_history")
    )
    p = p.select("sample_id", "event_id", early.alias("_early"), F.col("_sl").alias("line"), "_sp", "_bp")
    # A path that changed between: joined by line and path, so only paths that some commit renames meet.
    live = p.where("_early IS NULL").join(surviving, "sample_id")
    moved = live.join(structural, ["line", "path"]).where((F.col("place") > F.col("_sp")) & (F.col("place") <= F.col("_bp")))
    moved = moved.select("sample_id", "event_id").distinct().withColumn("_moved", F.lit(True))
    both = live.join(event_files, ["event_id", "path"]).groupBy("sample_id", "event_id").agg(F.array_sort(F.collect_set("path")).alias("_files"))
    done = p.join(moved, ["sample_id", "event_id"], "left").join(both, ["sample_id", "event_id"], "left")
    status = F.coalesce("_early", F.when(F.col("_moved"), "uncertain_file_identity"), F.lit("verified"))
    files = F.when(status == "verified", F.coalesce("_files", F.array().cast("array<string>")))
    return done.select("sample_id", "event_id", status.alias("status"), files.alias("matched"))


def is_match(status: Column, matched: Column) -> Column:
    """LB07: a verified line with a common file."""
    return F.coalesce((status == "verified") & (F.size(matched) > 0), F.lit(False))


def is_settled(status: Column) -> Column:
    """LB07: it is known whether the event touches the sample."""
    return F.coalesce(status.isin("verified", "unrelated_lineage"), F.lit(False))
