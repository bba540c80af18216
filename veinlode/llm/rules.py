"""Quality rules as a short-circuit cascade.

A text passes if no rule rejects it. Each rule is a DataFrame expression of its own. One job over a
sample (about a thousand rows by hash, whatever partition they lie in) evaluates every rule on
every row between two readings of the JVM's clock, so that a rule's cost is the time that its own
expression takes. Rules run by rejections per cost, best first, in one CASE expression that stops at
the first rule that rejects. The order changes the cost and the reported first rule, never the verdict.

Only DataFrame functions are used. Defined cases: null text and text without words has 0 words
and is rejected for being short; repeated rows are judged each by itself; every text is measured whole;
on an empty table rules run by name. Three-word windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, need

SYMBOLS = "[#*$%&|<>]"
Column = F.Column


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^{SPACE}]+"), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))


def repeat_words(w: Column) -> Column:
    """Words inside three-word windows that the text has twice or more.

    Windows are sorted by hash, so equal ones are neighbours; the places of those with an equal neighbour
    are sorted again, and each covers three words or as many as lie before the next place.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def places(s: Column) -> Column:
        same = lambda x, k: F.get(s, k)["h"] == x["h"]
        twice = F.filter(s, lambda x, i: F.coalesce(same(x, i + 1), F.lit(False)) | F.coalesce(F.when(i > 0, same(x, i - 1)), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def count(t: Column) -> Column:
        ordered = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        found = let(let(ordered, places), covered)
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(found)

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(let(hashes, windows), count)).cast("long")


def measured(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (an underscore more on names that clash)."""
    w, ln = fresh("_words", docs.columns), fresh("_lines", docs.columns)
    wide = docs.withColumns({w: words(text), ln: lines(text)})
    of_words, of_lines = F.col(f"`{w}`"), F.col(f"`{ln}`")
    made = {
        "n_words": F.size(of_words),
        "word_chars": F.length(F.concat_ws("", of_words)),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)),
        "n_lines": F.size(of_lines),
        "n_dup_lines": F.size(of_lines) - F.size(F.array_distinct(of_lines)),
        "n_repeat_words": repeat_words(of_words),
    }
    return wide.withColumns({fresh(n, docs.columns): e.cast("long") for n, e in made.items()}).drop(w, ln)


def standard_rules(text: Column, of: Mapping[str, Column]) -> dict[str, Column]:
    """Rules, true where they reject. They hold for running prose in any language. ``of``: what ``measured`` names, as
    its columns, or as expressions where nothing is measured before."""
    n = F.greatest(of["n_words"], F.lit(1))
    length = F.greatest(F.length(text), F.lit(1))
    return {
        "short": of["n_words"] < 50,
        "repeats": 100 * of["n_repeat_words"] > 50 * of["n_words"],
        "symbols": of["n_symbols"] > 0.3 * n,
        "shouting": F.regexp_count(text, F.lit(r"\p{Lu}")) > 0.4 * length,
        "cells": F.regexp_count(text, F.lit(r"\|")) > 0.2 * n,
        "marks": F.regexp_count(text, F.lit(r"[!?]{2}")) > 0.3 * n,
        "word length": (of["word_chars"] / n).between(2, 25) == F.lit(False),
        "same lines": of["n_dup_lines"] > 0.5 * of["n_lines"],
    }


def sample_of(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """About ``rows`` rows, four times as many at most: those whose hash over all columns that can be hashed lies below
    that share. Nothing is sorted, so only the sample moves."""
    place = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() != "map"]), F.lit(1 << 32))
    return docs.where(place < F.lit(int(min(1.0, rows / max(1, docs.count())) * (1 << 32)))).limit(4 * rows)


def ordered(sample: DataFrame, rules: Mapping[str, Column]) -> list[dict]:
    """Each rule's nanoseconds and rejections on the sample, best first; sorting is by rejections per cost, then cost, then name."""
    clock = F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    names = sorted(rules)
    # A branch that needn't be taken isn't shared with other rules, so each rule pays for its whole expression.
    timed = [F.struct(clock.alias("a"), F.when(F.rand() >= 0, rules[n]).alias("no"), clock.alias("b")).alias(f"r{i}") for i, n in enumerate(names)]
    cost = lambda i: F.sum(F.col(f"r{i}.b") - F.col(f"r{i}.a"))
    seen = sample.select(*timed).agg(*[F.struct(cost(i).alias("cost"), F.count_if(f"r{i}.no").alias("rejects")) for i in range(len(names))]).first()
    found = [{"rule": n, "cost": max(1, r.cost or 0), "rejects": r.rejects} for n, r in zip(names, seen)]
    return sorted(found, key=lambda r: (-r["rejects"] / r["cost"], r["cost"], r["rule"]))


def first_to_reject(rules: Mapping[str, Column], order: list[dict]) -> Column:
    verdict = F.lit(None).cast("string")
    for row in reversed(order):
        verdict = F.when(rules[row["rule"]], F.lit(row["rule"])).otherwise(verdict)
    return verdict


def cascade(docs: DataFrame, rules: Mapping[str, Column], name: str = "rejected_by", sample: DataFrame | None = None) -> DataFrame:
    """All columns and the first rule, in the order found, that rejects the row; null if none does. ``sample``: rows with
    the columns that the rules read, where taking them from ``docs`` would cost more."""
    order = ordered(sample_of(docs) if sample is None else sample, rules)
    return docs.withColumn(fresh(name, docs.columns), first_to_reject(rules, order))


def lazily(text: Column, w: Column) -> dict[str, Column]:
    """What ``measured`` names, as expressions that are evaluated where a rule needs them."""
    some = lines(text)
    return {
        "n_words": F.size(w), "word_chars": F.length(F.concat_ws("", w)), "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)),
        "n_lines": F.size(some), "n_dup_lines": let(some, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_repeat_words": repeat_words(w),
    }


def keep_fine(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents that no standard rule rejects, with their columns as they were. Nothing after the first rule that
    rejects is evaluated, so the costliest measures are spared where a cheap rule decides."""
    need(docs, text)
    of, w = F.col(f"`{text}`"), fresh("_words", docs.columns)
    order = ordered(sample_of(docs).withColumn(w, words(of)), standard_rules(of, lazily(of, F.col(f"`{w}`"))))
    return docs.where(let(words(of), lambda x: first_to_reject(standard_rules(of, lazily(of, x)), order)).isNull())


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def digest(docs: DataFrame) -> DataFrame:
    need(docs, "doc_id", "text")
    read = docs.select("doc_id", "text")
    rules = standard_rules(F.col("text"), {n: F.col(n) for n in (*MEASURES, "n_lines")})
    judged = cascade(measured(read, F.col("text")), rules, "rejected_by", measured(sample_of(read), F.col("text")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *MEASURES, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))
