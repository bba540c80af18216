"""Unified diffs: files, hunks, and lines with markers. A diff is cut inside the JVM, by its own line marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A snippet of a hunk has so many lines at most: a limit of the report itself.
SNIPPET = 12


def by_file(rows: DataFrame, key: str, diff: str) -> DataFrame:
    """SF20: (key, position, file, body) of each file of a diff; the file is its new path, or the old one if it is gone."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(diff, F.lit(""))), r"\ndiff --git ")
    cut = rows.select(key, F.posexplode(parts).alias("position", "body")).where("position > 0")
    new, old = F.regexp_extract("body", r"(?m)^\+\+\+ b/(.*)$", 1), F.regexp_extract("body", r"(?m)^--- a/(.*)$", 1)
    file = F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")), F.regexp_extract("body", r"^a/.* b/(.*)", 1))
    return cut.select(key, "position", file.alias("file"), "body")


def changed_lines(body: Column) -> Column:
    """The lines of a file's diff from its first hunk on, without the marks of hunks and of missing ends of file."""
    lines = F.split(F.regexp_extract(body, r"(?s)(?:^|\n)(@@ .*)", 1), "\n")
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("@@ ") & ~x.startswith("\\"))


def marked(files: DataFrame, body: str) -> DataFrame:
    """SF20, SX45: ``files`` with ``marked``: changed lines after <add>, <del> or <keep>, one to a line."""
    mark = lambda x: F.concat(F.when(x.startswith("+"), "<add>").when(x.startswith("-"), "<del>").otherwise("<keep>"), F.substr(x, F.lit(2)))
    return files.withColumn("marked", F.concat_ws("\n", F.transform(changed_lines(F.col(body)), mark)))


def prepared(rows: DataFrame, wanted: DataFrame, key: str, diff: str) -> DataFrame:
    """SX44: (key, prepared): the marked lines of the wanted files (key, file), each after its path, in the diff's order."""
    files = marked(by_file(rows, key, diff), "body").join(wanted.select(key, "file").distinct(), [key, "file"], "left_semi")
    each = F.struct("position", F.concat_ws("\n", "file", "marked").alias("x"))
    return files.groupBy(key).agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(each)), lambda p: p["x"])).alias("prepared"))


def hunks(rows: DataFrame, key: str, diff: str) -> DataFrame:
    """SF19: (key, file, hunk, first, last, lines, snippet): each hunk's lines on the new side, all of its lines, and the
    first of them as a snippet. A hunk that leaves nothing ends before it begins."""
    parts = by_file(rows, key, diff).select(key, "file", F.posexplode(F.split(F.concat(F.lit("\n"), F.col("body")), r"\n@@ ")).alias("hunk", "part")).where("hunk > 0")
    at = lambda i: F.regexp_extract("part", r"^-\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", i)
    first, n = at(1).cast("int"), F.coalesce(F.nullif(at(2), F.lit("")).cast("int"), F.lit(1))
    lines = F.filter(F.slice(F.split("part", "\n"), 2, F.greatest(F.size(F.split("part", "\n")) - 1, F.lit(0))), lambda x: (x != "") & ~x.startswith("\\"))
    cut = parts.select(key, "file", (F.col("hunk") - 1).alias("hunk"), first.alias("first"), (first + n - 1).alias("last"), lines.alias("lines"))
    return cut.withColumn("snippet", F.slice("lines", 1, SNIPPET))
