"""Pull-request, commit and change records: parsing of collected text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import last_per_key

NODE = (
    "number int, title string, body string, url string, state string, merged boolean, mergedAt string, createdAt string, updatedAt string, "
    "changedFiles int, author struct<login: string>, commits struct<pageInfo: struct<hasNextPage: boolean, endCursor: string>, "
    "nodes: array<struct<commit: struct<message: string>>>>"
)


def normalised(pages: DataFrame, value: str, owner: str, name: str) -> DataFrame:
    """IO08: API nodes, as JSON text with ``owner`` and ``name``, as flat records; wrong types become null."""
    n = pages.select(F.from_json(value, NODE).alias("n"), owner, name)
    repo = F.concat_ws("/", owner, name)
    return n.select(
        F.concat_ws("#", repo, F.col("n.number").cast("string")).alias("pr_id"), repo.alias("repo"), F.col("n.number").alias("pr_number"),
        F.coalesce("n.title", F.lit("")).alias("title"), F.coalesce("n.body", F.lit("")).alias("body"), F.col("n.state").alias("state"),
        F.coalesce("n.merged", F.lit(False)).alias("merged"), F.col("n.createdAt").alias("created_at"), F.col("n.mergedAt").alias("merged_at"),
        F.col("n.changedFiles").alias("changed_files"), F.col("n.author.login").alias("author"),
        F.transform("n.commits.nodes", lambda c: c["commit"]["message"]).alias("commit_messages"),
        (~F.coalesce("n.commits.pageInfo.hasNextPage", F.lit(True))).alias("commit_metadata_complete"),
    )


def commit_messages(pages: DataFrame, key: str, page: str, messages: str, more: str, cap: int) -> DataFrame:
    """IO09: a record's message pages in order, up to ``cap`` messages, and whether all of them are there."""
    s = pages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(page, messages, more))).alias("_p"))
    all_ = F.flatten(F.transform("_p", lambda p: p[messages]))
    complete = ~F.element_at("_p", -1)[more] & (F.size(all_) <= cap)
    return s.select(key, F.slice(all_, 1, cap).alias("messages"), complete.alias("complete"))


def pr_number(subject: Column) -> Column:
    """IO13: the number of a merge or squash subject."""
    number = F.coalesce(F.nullif(F.regexp_extract(subject, r"^Merge pull request #(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(subject, r"\(#(\d+)\)\s*$", 1), F.lit("")))
    return number.cast("int")


def merged_prs(log: DataFrame) -> DataFrame:
    """IO13: landed change sets of ``log`` lines (sha, parents, time, subject by tabs); the newest commit of a number wins."""
    p = F.split("value", "\t", 4)
    rows = log.select(p[0].alias("sha"), F.split(p[1], " ")[0].alias("before_sha"), F.try_to_timestamp(p[2]).alias("merged_at"), p[3].alias("title"))
    rows = rows.withColumn("number", pr_number(F.col("title"))).where("number IS NOT NULL").withColumn("_at", F.struct("merged_at", "sha"))
    return last_per_key(rows, ["number"], "_at").drop("_at").orderBy("merged_at", "number")


def changes(status: Column) -> Column:
    """IO15, IO16: a NUL-delimited name-status text as array<struct<status, before, after>>; R and C take two paths."""
    parts = F.filter(F.split(status, "\0"), lambda x: x != "")
    none = F.lit(None).cast("string")
    row = "struct<status: string, before: string, after: string>"
    start = F.struct(none.alias("s"), none.alias("a"), F.array().cast(f"array<{row}>").alias("out"))

    def step(st: Column, x: Column) -> Column:
        kind = F.substring(st["s"], 1, 1)
        make = lambda a, b: F.struct(st["s"].alias("status"), a.alias("before"), b.alias("after"))
        wide = kind.isin("R", "C")
        one = F.when(kind == "A", make(none, x)).when(kind == "D", make(x, none)).otherwise(make(x, x))
        done = F.struct(none.alias("s"), none.alias("a"), F.concat(st["out"], F.array(F.when(wide, make(st["a"], x)).otherwise(one))).alias("out"))
        wait = F.struct(st["s"].alias("s"), x.alias("a"), st["out"].alias("out"))
        return F.when(st["s"].isNull(), F.struct(x.alias("s"), none.alias("a"), st["out"].alias("out"))).when(wide & st["a"].isNull(), wait).otherwise(done)

    return F.aggregate(parts, start, step, lambda st: st["out"])


def pr_id(explicit: Column, repo: Column, number: Column) -> Column:
    """SX08: the given id, else repo#number."""
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), F.concat_ws("#", repo, number.cast("string")))


def first_per_repo(rows: DataFrame, repo: str, order: str, n: int) -> DataFrame:
    """IO27: the first n rows of each repository."""
    from ..operators.temporal import ranked_cut

    return ranked_cut(rows, [repo], [F.asc(order)], n)
