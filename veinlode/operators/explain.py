"""Attribution of scores, in closed form for linear scorers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import binary_kl, sigmoid


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def branches(bias: Column, first: tuple[Column, Column], second: tuple[Column, Column]) -> dict[str, Column]:
    """XR07: base, structure and diff contributions that add up to the logit."""
    a, b = dot(*first), dot(*second)
    return {"base": bias, "structure": a, "diff": b, "logit": bias + a + b}


def two_player(none: Column, a: Column, b: Column, both: Column) -> dict[str, Column]:
    """XR05: exact Shapley values of two players from the scores of the four coalitions."""
    return {"base": none, "structure": ((a - none) + (both - b)) / 2, "history": ((b - none) + (both - a)) / 2}


def linear_gradients(parts: DataFrame, weight: str, value: str) -> DataFrame:
    """XR01: integrated gradients of a linear scorer: weight times value, with no completeness gap."""
    return parts.withColumn("attribution", F.col(weight) * F.col(value))


def unfaithfulness(parts: DataFrame, sample: str, attribution: str, tie: str, k: int) -> DataFrame:
    """XR04: 1 - exp(-KL) between the scores with all parts and with the k largest by absolute attribution."""
    w = Window.partitionBy(sample).orderBy(F.desc(F.abs(attribution)), tie)
    r = parts.withColumn("_r", F.row_number().over(w))
    s = r.groupBy(sample).agg(F.sum(attribution).alias("_all"), F.sum(F.when(F.col("_r") <= k, F.col(attribution)).otherwise(0.0)).alias("_top"))
    clip = lambda p: F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    kl = binary_kl(clip(sigmoid(F.col("_all"))), clip(sigmoid(F.col("_top"))))
    return s.select(sample, (1 - F.exp(-kl)).alias("unfaithfulness"))


def by_file(parts: DataFrame, sample: str, file: str, attribution: str, touched: str) -> DataFrame:
    """AG13: attribution by file, unknown files under one name; touched if any part is."""
    name = F.coalesce(F.nullif(F.col(file), F.lit("")), F.lit("(external)")).alias("file")
    return parts.groupBy(sample, name).agg(F.sum(attribution).alias("attribution"), F.bool_or(touched).alias("touched"))


def rouge_n(pairs: DataFrame, key: str, candidate: str, reference: str, n: int) -> DataFrame:
    """EV20: (key, precision, recall, f1) of word n-grams, counted as multisets."""

    def grams(text: str) -> DataFrame:
        w = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
        cut = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.concat_ws(" ", F.slice(w, i, n)))
        listed = pairs.select(key, F.explode(F.when(F.size(w) >= n, cut)).alias("g"))
        return listed.groupBy(key, "g").agg(F.count("*").alias("c"))

    a, b = grams(candidate).withColumnRenamed("c", "a"), grams(reference).withColumnRenamed("c", "b")
    s = a.join(b, [key, "g"], "full_outer").groupBy(key).agg(
        F.sum(F.coalesce(F.least("a", "b") * (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int"), F.lit(0))).alias("m"), F.sum("a").alias("na"), F.sum("b").alias("nb")
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    p, r = zero(F.col("m") / F.col("na")), zero(F.col("m") / F.col("nb"))
    return s.select(key, p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def rouge_l(pairs: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """EV20: F1 of the longest common subsequence of words."""
    def length(a: list, b: list) -> int:
        row = [0] * (len(b) + 1)
        for x in a:
            left = 0
            for j, y in enumerate(b, 1):
                row[j], left = (left + 1 if x == y else max(row[j], row[j - 1])), row[j]
        return row[-1]

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            m = length(list(x), list(y))
            out.append(2 * m / (len(x) + len(y)) if m else 0.0)
        return pd.Series(out)

    w = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))
    return pairs.select(key, score(w(candidate), w(reference)).alias("f1"))


def template_answer(sample: Column, score: Column, threshold: Column, top: Column) -> Column:
    """XR20: the offline writer: a verdict and its evidence from a template; other writers are injected as columns."""
    verdict = F.when(score >= threshold, "likely to degrade").otherwise("not likely to degrade")
    return F.concat_ws(" ", sample, F.lit("is"), verdict, F.format_string("(%.3f).", score), F.lit("Evidence:"), F.concat_ws(", ", top))
