"""Collecting records: cursors, waits, file contents at commits, commit pairs, changed paths, and checks of what was prepared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.history import changes
from ..sources.store import last_per_key


def cursors(updates: DataFrame, repos: DataFrame, repo: str, order: str) -> DataFrame:
    """IO05: (repo, cursor, completed) of every repository: its last update, else no cursor and not completed."""
    last = last_per_key(updates.select(repo, "cursor", "completed", order), [repo], order).drop(order)
    return repos.select(repo).join(last, repo, "left").withColumn("completed", F.coalesce("completed", F.lit(False)))


def wait(remaining: Column, reset_at: Column, now: Column, threshold: int, most: int) -> Column:
    """IO11: struct<action, seconds> after a reply: ``go`` above the threshold or without a number, ``low`` while some calls are
    left, and when none is left ``wait`` until a second after the reset, ``too_long`` beyond the longest wait, or ``unknown``
    without a reset time."""
    left = F.unix_timestamp(reset_at) - F.unix_timestamp(now)
    seconds = F.when(left < 0, F.lit(0)).otherwise(left) + 1  # null without a reset time
    action = (
        F.when(remaining.isNull() | (remaining > threshold), "go")
        .when(remaining > 0, "low")
        .when(seconds.isNull(), "unknown")
        .when(seconds <= most, "wait")
        .otherwise("too_long")
    )
    return F.struct(action.alias("action"), F.when(action.isin("wait", "too_long"), seconds).alias("seconds"))


def read_side(wanted: DataFrame, blobs: DataFrame, key: Sequence[str]) -> DataFrame:
    """IO14, SX42: the blobs of the wanted keys, each once; keys without a blob are left out."""
    return blobs.join(wanted.select(*key).distinct(), list(key), "left_semi")


def blob_problems(wanted: DataFrame, blobs: DataFrame, key: Sequence[str], size: str, content: str) -> DataFrame:
    """IO14: (key, problem) of wanted keys that have no blob, or one of another length in bytes than stated."""
    found = blobs.select(*key, (F.octet_length(content) == F.col(size)).alias("_whole"))
    both = wanted.select(*key).distinct().join(found, list(key), "left")
    problem = F.when(F.col("_whole").isNull(), "missing").when(~F.col("_whole"), "truncated")
    return both.select(*key, problem.alias("problem")).where("problem IS NOT NULL")


def structural_history(log: DataFrame, sha: str, status: str) -> DataFrame:
    """IO16: (sha, status, before, after): the additions, deletions, renames and copies of each commit against its first parent."""
    rows = log.select(sha, F.explode(changes(F.col(status))).alias("c"))
    return rows.select(sha, F.substring("c.status", 1, 1).alias("status"), "c.before", "c.after").where(F.col("status").isin("A", "D", "R", "C"))


def changed_paths(log: DataFrame, sha: str, status: str, suffix: str = ".py") -> DataFrame:
    """IO17, SX06: (sha, path): the distinct paths, of both sides of a rename, that end in ``suffix``."""
    rows = log.select(sha, F.explode(changes(F.col(status))).alias("c"))
    return rows.select(sha, F.explode(F.array("c.before", "c.after")).alias("path")).where(F.col("path").endswith(suffix)).distinct()


def is_done(values: Column, tool: str) -> Column:
    """IO19: whether a row's map has a value of the tool, even a null one: a failure is final."""
    return F.coalesce(F.exists(F.map_keys(values), lambda k: k.startswith(f"{tool}.")), F.lit(False))


def leaves_folder(path: Column) -> Column:
    """Whether a relative path is empty, absolute, or leads out of its folder at any step."""
    step = lambda x: F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    walk = lambda s, x: F.struct((s["d"] + step(x)).alias("d"), F.least(s["m"], s["d"] + step(x)).alias("m"))
    lowest = F.aggregate(F.split(path, "/"), start, walk, lambda s: s["m"])
    return F.coalesce((path == "") | path.startswith("/") | (lowest < 0), F.lit(True))


def sample_problems(records: DataFrame) -> DataFrame:
    """IO21: (path, problem) of metadata records (path, sample_id, label, graph_path): an id that is missing or that a record of
    an earlier path has, a label that isn't 0 or 1, or a graph outside the record's folder. The first problem is named."""
    first = records.groupBy("sample_id").agg(F.min("path").alias("_first"))
    rows = records.join(first, "sample_id", "left")  # null ids find none
    problem = (
        F.when(F.coalesce(F.col("sample_id"), F.lit("")) == "", "id")
        .when(F.col("path") != F.col("_first"), "id")
        .when(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "label")
        .when(leaves_folder(F.col("graph_path")), "graph")
    )
    return rows.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def manifest(records: DataFrame, splits: DataFrame, repo: str, names: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """IO24: the hand-off columns of each record with its repository's split, under the split's outward name."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return records.join(splits, repo).select(*columns, known[F.col("split")].alias("split"))


def pack(graphs: DataFrame, names: Sequence[str], path: str) -> None:
    """IO26: write graphs (…, features) with the names of their features."""
    wide = F.size("features") == len(names)
    checked = F.when(wide, F.col("features")).otherwise(F.raise_error(F.lit("a graph has other features than named")).cast("array<double>"))
    graphs.withColumn("features", checked).withColumn("feature_names", F.array(*[F.lit(x) for x in names])).write.mode("overwrite").parquet(path)


def load_packed(packed: DataFrame, names: Sequence[str]) -> DataFrame:
    """IO26: the packed graphs; a file that was packed for other features is an error."""
    same = F.col("feature_names") == F.array(*[F.lit(x) for x in names])
    checked = F.when(same, F.col("features")).otherwise(F.raise_error(F.lit("packed for other features")).cast("array<double>"))
    return packed.withColumn("features", checked).drop("feature_names")


def completed(needed: DataFrame, stored: DataFrame, key: str, compute) -> DataFrame:
    """SX02: the stored summaries of the needed keys, and those that ``compute`` makes of the keys without one."""
    wanted = needed.select(key).distinct()
    fresh = compute(wanted.join(stored, key, "left_anti"))
    return stored.join(wanted, key, "left_semi").unionByName(fresh)


def commit_pairs(parents: DataFrame) -> DataFrame:
    """SX04: (sha, before_sha): each commit and its first parent; ``parents`` has (sha, position, parent). A root has no row."""
    return parents.where("position = 0").select("sha", F.col("parent").alias("before_sha"))


def verified_pairs(records: DataFrame, parents: DataFrame) -> DataFrame:
    """SX05: (sha, before_sha, status) of records (sha, head_sha, commits, before_sha).

    ``merge_head_verified`` if the second of two parents is the head, ``single_commit_boundary`` if one parent and one commit;
    ``wrong_before`` where a supplied start is another than the first parent; else ``unverified``, or ``unresolved`` without a parent.
    """
    p = parents.groupBy("sha").agg(
        F.count("*").alias("_n"), F.max(F.when(F.col("position") == 0, F.col("parent"))).alias("_first"), F.max(F.when(F.col("position") == 1, F.col("parent"))).alias("_second")
    )
    merge = F.coalesce((F.col("_n") == 2) & (F.col("_second") == F.lower("head_sha")), F.lit(False))
    single = F.coalesce((F.col("_n") == 1) & (F.col("commits") == 1), F.lit(False))
    status = (
        F.when(F.col("_first").isNull(), "unresolved")
        .when(~merge & ~single, "unverified")
        .when(F.col("before_sha") != F.col("_first"), "wrong_before")
        .when(merge, "merge_head_verified")
        .otherwise("single_commit_boundary")
    )
    return records.join(p, "sha", "left").select("sha", F.col("_first").alias("before_sha"), status.alias("status"))


def whole_samples(metrics: DataFrame, diffs: DataFrame, histories: DataFrame, key: str) -> DataFrame:
    """SX15: samples that have all three parts."""
    return metrics.join(diffs, key).join(histories, key)


def map_columns(rows: DataFrame, values: str, names: Sequence[str], empty: float = 0.0) -> DataFrame:
    """SX16: a map's named values as columns, ``empty`` where it has none."""
    return rows.withColumns({n: F.coalesce(F.try_element_at(F.col(values), F.lit(n)), F.lit(empty)) for n in names}).drop(values)


def scaler_problems(scaler: DataFrame) -> DataFrame:
    """SX17: (name, problem) of features (name, mean, std) whose mean or deviation isn't finite, or whose deviation isn't above 0."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    problem = F.when(~finite("mean") | ~finite("std"), "not finite").when(F.col("std") <= 0, "no spread")
    return scaler.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def reuse(live: DataFrame, stored: DataFrame, key: str, revision: Sequence[str]) -> DataFrame:
    """SX20: (key, action): ``prepare`` a sample that isn't stored, ``reuse`` one of the same revision, ``refuse`` another's."""
    old = stored.select(key, *[F.col(c).alias(f"_{c}") for c in revision], F.lit(True).alias("_there"))
    same = F.lit(True)
    for c in revision:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    action = F.when(F.col("_there").isNull(), "prepare").when(same, "reuse").otherwise("refuse")
    return live.join(old, key, "left").select(key, action.alias("action"))


def resumed(pages: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """IO06: (repo, retrieved, cursor, completed) after a run that reads pages (repo, page, n) behind the stored cursor until it has
    ``most`` rows. A completed repository isn't read again; the cursor is null once there is no further page."""
    ahead = pages.join(state, "repo").where(~F.col("completed") & F.coalesce(F.col("page") > F.col("cursor"), F.lit(True))).select("repo", "page", "n")
    run = Window.partitionBy("repo").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # a row per page
    read = ahead.withColumn("_before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    taken = F.col("_before") < most
    done = read.groupBy("repo").agg(F.sum(F.when(taken, F.col("n"))).alias("_k"), F.max(F.when(taken, F.col("page"))).alias("_at"), F.max("page").alias("_end"))
    over = F.col("completed") | F.col("_end").isNull() | (F.col("_at") == F.col("_end"))
    out = state.join(done, "repo", "left")
    return out.select("repo", F.coalesce("_k", F.lit(0)).alias("retrieved"), F.when(~over, F.col("_at")).alias("cursor"), over.alias("completed"))


def window_coverage(nodes: DataFrame, windows: DataFrame, most_pages: int) -> DataFrame:
    """IO07: (repo, pages, scanned, collected, completed, reason) of a traversal by creation time that stops with the page that
    holds a row created after the window's end; collected are the rows merged inside the window.

    ``nodes``: (repo, page, created, merged); ``windows``: (repo, start, end). Without such a page the traversal is complete
    only when no page is left within ``most_pages``.
    """
    rows = nodes.join(windows, "repo")
    pages = rows.groupBy("repo", "page").agg(
        F.count("*").alias("n"), F.count_if(F.col("merged").between(F.col("start"), F.col("end"))).alias("k"), F.max((F.col("created") > F.col("end")).cast("int")).alias("past")
    )
    before = Window.partitionBy("repo").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # a row per page
    walked = pages.withColumns({"_seen": F.coalesce(F.max("past").over(before), F.lit(0)), "_i": F.count("*").over(before)})
    read = (F.col("_seen") == 0) & (F.col("_i") < most_pages)
    took = lambda c: F.coalesce(F.sum(F.when(read, F.col(c))), F.lit(0))
    total = walked.groupBy("repo").agg(F.count_if(read).alias("pages"), took("n").alias("scanned"), took("k").alias("collected"), took("past").alias("_past"), F.count("*").alias("_all"))
    reason = F.when(F.col("_past") > 0, "created_after_window_end").when(F.col("pages") == F.col("_all"), "connection_exhausted")
    return total.select("repo", "pages", "scanned", "collected", reason.isNotNull().alias("completed"), reason.alias("reason"))


def audit_summary(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """LB11: one row of counts over audited change sets.

    ``rows``: (sample_id, status, files_match, followup, provisional); ``changes``: (sample_id, status, syntax, structural), the production
    files of each. Only rows of status ``audited`` count beyond ``records``.
    """
    kind = F.substring("status", 1, 1)
    of = changes.groupBy("sample_id").agg(
        F.bool_or(kind == "D").alias("_d"), F.bool_or(kind == "R").alias("_r"), F.bool_or(F.col("syntax") == "unresolved").alias("_u"),
        F.bool_or(kind.isin("A", "D", "R", "C") | F.col("structural")).alias("_s"),
    )
    ok, production = F.col("status") == "audited", F.col("_d").isNotNull()
    n = lambda test, name: F.count_if(ok & test).alias(name)
    late = production & F.col("followup")
    return rows.join(of, "sample_id", "left").agg(
        F.count("*").alias("records"), n(F.lit(True), "audited"), n(production, "production"), n(~F.col("files_match"), "count_mismatches"), n(F.col("_d"), "with_deletions"),
        n(F.col("_r"), "with_renames"), n(F.col("_u"), "with_parse_errors"), n(late, "full_followup"), n(late & ~F.col("provisional") & F.col("files_match"), "checks_passed"), n(F.col("_s"), "review_candidates"),
    )


def with_fallback(answer: Column, error: Column, second: Column, names: tuple[str, str]) -> Column:
    """XR24: struct<answer, used, note>: the first model's answer, or the second's where the first had an error of the model or of its
    rate; other errors give no answer."""
    why = F.when(error == "model", "is not available to this key").when(error == "rate", "is rate-limited right now")
    note = F.concat(F.lit(f"{names[0]} "), why, F.lit(f"; answered with {names[1]}."))
    took = why.isNotNull() & second.isNotNull()
    return F.struct(
        F.when(error.isNull(), answer).when(took, second).alias("answer"), F.when(error.isNull(), names[0]).when(took, names[1]).alias("used"), F.when(error.isNull(), "").when(took, note).alias("note")
    )
