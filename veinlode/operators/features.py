"""Features of change sets: hotspots, sizes, scaling, token bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import epoch_years
from ..sources.store import cut


def hotspots(files: DataFrame, changes: DataFrame, complexity: DataFrame) -> DataFrame:
    """FE11, FE12: (sample, total, most, hottest, mean_product) from (sample, file), (file, changes), (file, complexity)."""
    rows = files.join(changes, "file", "left").join(complexity, "file").withColumn("c", F.coalesce("changes", F.lit(0)))
    return rows.groupBy("sample").agg(
        F.sum("c").alias("total"),
        F.max("c").alias("most"),
        F.max(F.col("c") * F.col("complexity")).alias("hottest"),
        (F.sum("c") * F.avg("complexity")).alias("mean_product"),
    )


def fit_scaler(rows: DataFrame, columns: list[str], log: bool = True, least: float = 1e-6) -> DataFrame:
    """AG07, FE07, FE08: one row of mean and population deviation (at least ``least``) per column."""
    x = lambda c: F.log1p(F.col(c)) if log else F.col(c)
    return rows.agg(*[F.avg(x(c)).alias(f"{c}_mean") for c in columns], *[F.greatest(F.stddev_pop(x(c)), F.lit(least)).alias(f"{c}_std") for c in columns])


def apply_scaler(rows: DataFrame, scaler: DataFrame, columns: list[str], log: bool = True) -> DataFrame:
    """FE07, FE08: standardised columns; the scaler is one row."""
    x = lambda c: F.log1p(F.col(c)) if log else F.col(c)
    both = rows.crossJoin(F.broadcast(scaler))
    return both.select(*[c for c in rows.columns if c not in columns], *[((x(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(c) for c in columns])


def change_sizes(diff: Column) -> dict[str, Column]:
    """FE03, SF18: log of added and removed lines, files and hunks of a unified diff."""
    lines = F.split(F.coalesce(diff, F.lit("")), "\n")
    count = lambda test: F.log1p(F.size(F.filter(lines, test)))
    return {
        "added": count(lambda x: x.startswith("+") & ~x.startswith("+++")),
        "removed": count(lambda x: x.startswith("-") & ~x.startswith("---")),
        "files": count(lambda x: x.startswith("diff --git ")),
        "hunks": count(lambda x: x.startswith("@@")),
    }


def diff_tokens(diff: Column) -> Column:
    """FE05: identifiers of added lines as A_x, of removed ones as R_x, in order."""
    lines = F.split(F.coalesce(diff, F.lit("")), "\n")
    names = lambda x: F.regexp_extract_all(x, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    mark = lambda x, m: F.transform(names(x), lambda n: F.concat(F.lit(m), n))
    changed = F.filter(lines, lambda x: (x.startswith("+") & ~x.startswith("+++")) | (x.startswith("-") & ~x.startswith("---")))
    return F.flatten(F.transform(changed, lambda x: F.when(x.startswith("+"), mark(x, "A_")).otherwise(mark(x, "R_"))))


def tfidf(tokens: DataFrame, key: str, token: str, train: Column, min_df: int, max_terms: int) -> DataFrame:
    """FE06: (key, token, weight): 1 + ln tf, smooth idf from the training rows, unit length.

    Terms: in ``min_df`` training documents at least, the ``max_terms`` commonest (ties by term). The terms are joined
    back as a table, so the vocabulary may be of any size.
    """
    tf = cut(tokens.groupBy(key, token).agg(F.count("*").alias("tf"), F.max(train.cast("int")).alias("_train")))
    df = tf.where("_train = 1").groupBy(token).agg(F.count("*").alias("df"), F.sum("tf").alias("all")).where(F.col("df") >= min_df)
    terms = df.orderBy(F.desc("all"), token).limit(max_terms)
    n = tf.where("_train = 1").agg(F.countDistinct(key).alias("n"))
    idf = terms.crossJoin(F.broadcast(n)).select(token, (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, token).select(key, token, ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))  # a group is one document's terms
    return w.select(key, token, (F.col("w") / norm).alias("weight"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """SX11: (label, weight) with weight n / (classes * n of the class)."""
    c = rows.groupBy(label).agg(F.count("*").alias("k"))
    s = c.agg(F.sum("k").alias("n"), F.count("*").alias("classes"))
    return c.crossJoin(F.broadcast(s)).select(label, (F.col("n") / (F.col("classes") * F.col("k"))).alias("weight"))


def shortcut_features(samples: DataFrame) -> DataFrame:
    """FE02: (sample, merge_years, log_nodes, log_edges, log_modules) from (sample, merged_at, nodes, edges, modules)."""
    return samples.select("sample", epoch_years(F.col("merged_at")).alias("merge_years"), *[F.log1p(c).alias(f"log_{c}") for c in ("nodes", "edges", "modules")])


def metric_columns(before: DataFrame, after: DataFrame, change: DataFrame, key: str, metrics: list[str], changes: list[str]) -> DataFrame:
    """FE04: per sample each metric before the change and its difference to after, and the counts of changes, as doubles."""
    a = before.select(key, *[F.col(m).cast("double").alias(f"before_{m}") for m in metrics])
    b = after.select(key, *[F.col(m).cast("double").alias(f"_{m}") for m in metrics])
    c = change.select(key, *[F.col(m).cast("double").alias(f"change_{m}") for m in changes])
    delta = [(F.col(f"_{m}") - F.col(f"before_{m}")).alias(f"delta_{m}") for m in metrics]
    return a.join(b, key).join(c, key).select(key, *[f"before_{m}" for m in metrics], *delta, *[f"change_{m}" for m in changes])


def tool_features(rows: DataFrame, key: str, train: Column, names: list[str], least: float = 0.99) -> tuple[str, DataFrame]:
    """FE13: rows with one column per metric, null where a tool failed. If ``least`` of the samples have a value, ("full", all of
    them, with nulls filled by the median of the training rows); else ("delta", the changes alone of the covered ones)."""
    some = F.coalesce(*[F.col(n).cast("double") for n in names])
    s = rows.agg(F.avg(some.isNotNull().cast("double")).alias("share"), *[F.percentile(F.when(train, F.col(n)), 0.5).alias(n) for n in names]).first()
    if (s["share"] or 0.0) < least:
        return "delta", rows.where(some.isNotNull()).select(key, *[n for n in names if n.startswith("delta_")])
    return "full", rows.select(key, *[F.coalesce(F.col(n).cast("double"), F.lit(s[n]).cast("double")).alias(n) for n in names])


def side_totals(files: DataFrame, key: str, value: str, measured: DataFrame) -> DataFrame:
    """FE09, FE14: per sample the total of each side and the change, from (key, side, value) of its files. ``measured``: (key,
    side) that the tool has read: a side without files counts 0 there, and is null where it wasn't read."""
    total = files.groupBy(key, "side").agg(F.sum(value).alias("_t"))
    both = measured.select(key, "side").distinct().join(total, [key, "side"], "left").withColumn("_t", F.coalesce("_t", F.lit(0.0)))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("_t"))).alias(side)
    return both.groupBy(key).agg(of("before"), of("after")).withColumn("delta", F.col("after") - F.col("before"))
