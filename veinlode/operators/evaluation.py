"""Ranking and set metrics, exact in ties, as aggregations. Predictions are long: (model or split keys, label, score).

Rows are first counted by distinct score, so the windows run over scores, and a hot split stays small.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import f1, hash_hex, ratio
from .places import numbered, running


def confusion(rows: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """EV01: counts at score >= threshold and rates, 0 where a denominator is."""
    hit = F.col("score") >= threshold
    pos = F.col("label") == 1
    c = rows.groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn")
    )
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), n)).withColumn("flagged", ratio(F.col("tp") + F.col("fp"), n))


def by_score(rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Counts of each distinct score, and the running and total ones from the highest score on; a row counts ``weight`` times."""
    w = F.lit(1) if weight is None else F.col(weight)
    s = rows.groupBy(*by, "score").agg(F.sum(F.col("label").cast("long") * w).alias("hits"), F.sum(w).alias("n"))
    if weight is not None:
        s = s.where("n > 0")
    down = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    return s.withColumns(
        {"tp": F.sum("hits").over(down), "seen": F.sum("n").over(down), "positives": F.sum("hits").over(all_), "rows": F.sum("n").over(all_)}
    )


def average_precision(rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """EV02, WN11: precision at the end of each tie group, weighted by the group's hits; 0 without positives."""
    s = by_score(rows, by, weight)
    return s.groupBy(*by).agg(F.sum(F.when(F.col("positives") > 0, F.col("hits") / F.col("positives") * F.col("tp") / F.col("seen")).otherwise(0.0)).alias("ap"))


def roc_auc(rows: DataFrame, by: list[str]) -> DataFrame:
    """EV03: share of pairs in order, ties one half; null if a class is missing."""
    s = by_score(rows, by)
    lower = (F.col("rows") - F.col("positives")) - (F.col("seen") - F.col("tp"))  # negatives with a lower score
    won = F.col("hits") * (lower + (F.col("n") - F.col("hits")) / 2)
    pairs = F.max("positives") * (F.max("rows") - F.max("positives"))
    return s.groupBy(*by).agg(F.when(pairs > 0, F.sum(won) / pairs).alias("auc"))


def precision_at(rows: DataFrame, by: list[str], tie: str, share: float = 0.2) -> DataFrame:
    """EV04, WN10: positives among the first ceil(share * n) rows by score, then ``tie``."""
    placed = numbered(rows, by, [F.desc("score"), tie])
    return placed.where(F.col("_p") < F.ceil(F.col("_n") * share)).groupBy(*by).agg(F.avg("label").alias("precision_at"))


def best_threshold(rows: DataFrame, by: list[str], rule: str = "lowest") -> DataFrame:
    """EV05: the distinct score with the best F1; ties by the lowest threshold, by precision then the highest
    threshold, or by nearness to 0.5."""
    s = by_score(rows, by)
    p, r = F.col("tp") / F.col("seen"), ratio(F.col("tp"), F.col("positives"))
    s = s.select(*by, "score", F.round(f1(p, r), 12).alias("f1"), F.round(p, 12).alias("precision"))
    order = {
        "lowest": F.struct("f1", (-F.col("score")).alias("t")),
        "precise": F.struct("f1", "precision", "score"),
        "middle": F.struct("f1", (-F.abs(F.col("score") - 0.5)).alias("t"), (-F.col("score")).alias("u")),
    }[rule]
    return s.groupBy(*by).agg(F.max_by("score", order).alias("threshold"), F.max("f1").alias("f1"))


def set_scores(found: DataFrame, gold: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """EV10 to EV12, AG09: tp, fp, fn, and rates that are null where undefined, by group and over all (null group)."""
    a = found.select(*by, *keys).distinct().withColumn("_a", F.lit(1))
    b = gold.select(*by, *keys).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, [*by, *keys], "full_outer")
    c = both.rollup(*by).agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("tp"), F.count_if(F.col("_b").isNull()).alias("fp"), F.count_if(F.col("_a").isNull()).alias("fn")
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), None), ratio(F.col("tp"), F.col("tp") + F.col("fn"), None)
    agree = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), None)
    return c.withColumns({"precision": p, "recall": r, "f1": agree})


def poisson_weight(key: str, seed: str) -> F.Column:
    """How often ``resample`` draws a row: Poisson(1) from a shared hash."""
    u = hash_hex(F.col("resample"), F.col(key), seed=seed)
    steps, term, total = F.lit(0), 1.0, 0.0
    for k in range(1, 8):  # Poisson(1): cumulative e^-1 / k!
        total += 0.36787944117144233 * term
        term /= k
        # Every step is looked at, so that the hash is computed once a row.
        steps = steps + (u >= F.lit(f"{math.ceil(total * 16**12):012x}")).cast("int")
    return steps


def resampled(rows: DataFrame, resamples: int) -> DataFrame:
    return rows.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))


def bootstrap_means(rows: DataFrame, key: str, value: str, resamples: int, seed: str = "boot") -> DataFrame:
    """EV07, EV14: the mean of each resample. Rows are drawn with replacement by Poisson weights from a shared hash,
    so a resample needs no index into the data and any engine can repeat it."""
    w = resampled(rows.select(key, value), resamples).withColumn("_w", poisson_weight(key, seed))
    return w.groupBy("resample").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("mean"))


def paired_comparison(ours: DataFrame, other: DataFrame, key: str, resamples: int = 1000, seed: str = "pair") -> DataFrame:
    """EV08: mean difference of average precision of two models (key, label, score), ours less the other, and the share
    of resamples that ours wins. Both are weighted by the same Poisson draws of the samples that both have."""
    both = ours.select(key, "label", F.col("score").alias("_a")).join(other.select(key, F.col("score").alias("_b")), key)
    # Few rows become many in place, so they are dealt to all cores first. Draws are summed by label and pair of scores, the
    # zeros too: a filter on the weight would have every hash computed again.
    spread = both.repartition(3 * both.sparkSession.sparkContext.defaultParallelism)
    drawn = resampled(spread, resamples).groupBy("resample", "label", "_a", "_b").agg(F.sum(poisson_weight(key, seed)).alias("_w"))
    scores = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_{m}").alias("score")) for m in "ab"]))
    ap = average_precision(drawn.select("resample", "label", "_w", scores.alias("s")).select("resample", "label", "_w", "s.*"), ["resample", "model"], "_w")
    d = ap.groupBy("resample").agg(F.sum(F.when(F.col("model") == "a", F.col("ap")).otherwise(-F.col("ap"))).alias("d"))
    return d.agg(F.count("*").alias("resamples"), F.avg("d").alias("mean_difference"), F.avg((F.round("d", 9) > 0).cast("int")).alias("share_won"))


def middle_95(rows: DataFrame, value: str) -> DataFrame:
    """SX13: linear quantiles at 2.5 and 97.5 %."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return rows.agg(q.alias("_q")).select(F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def holm(tests: DataFrame, p: str, name: str) -> DataFrame:
    """WN13: step-down adjusted p-values, at most 1."""
    w = Window.orderBy(p, name)  # one row per test
    n = F.count("*").over(Window.partitionBy())
    raw = tests.withColumn("_x", F.col(p) * (n - F.row_number().over(w) + 1))
    return raw.withColumn("adjusted", F.least(F.lit(1.0), F.max("_x").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_x")


def signed_ranks(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """EV16: Wilcoxon's statistic (smaller rank sum), zero differences dropped, ties at their mean rank."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0")
    c = d.groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = running(c, [], ["m"], "n", "_c").withColumn("rank", F.col("_c") - F.col("n") + (F.col("n") + 1) / 2)
    s = ranked.agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("minus"))
    return s.withColumn("statistic", F.least("plus", "minus"))


def friedman(rows: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """EV16: Friedman's chi-square with mean ranks for ties (and the correction for them)."""
    w = Window.partitionBy(block)
    rank = F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(block, value)) - 1) / 2
    r = rows.select(block, treatment, rank.alias("r"), F.count("*").over(Window.partitionBy(block, value)).alias("t"))
    k = r.groupBy(treatment).agg(F.sum("r").alias("R"), F.count("*").alias("n"))
    s = k.agg(F.count("*").alias("k"), F.max("n").alias("n"), F.sum(F.col("R") * F.col("R")).alias("rr"))
    ties = r.agg(F.sum(F.col("t") * F.col("t") - 1).alias("ties"))
    both = s.crossJoin(ties)  # one row each
    n, kk = F.col("n"), F.col("k")
    raw = 12 / (n * kk * (kk + 1)) * F.col("rr") - 3 * n * (kk + 1)
    return both.select("n", "k", (raw / (1 - F.col("ties") / (n * kk * (kk * kk - 1)))).alias("chi2"))


def krippendorff_ordinal(ratings: DataFrame, unit: str, value: str) -> DataFrame:
    """EV17: alpha for ordinal ratings, missing ones allowed. Values are counted per unit before they meet."""
    c = ratings.where(F.col(value).isNotNull()).groupBy(unit, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    c = c.withColumn("m", F.sum("n").over(Window.partitionBy(unit))).where("m > 1")
    marg = c.groupBy("v").agg(F.sum("n").alias("n"))
    run = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    g = marg.select("v", "n", (run - F.col("n") / 2).alias("mid"))  # distance: ranks between, ends at one half
    dist = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    x = c.join(g.select("v", "mid"), "v")
    pairs = x.alias("a").join(x.alias("b"), unit).select(
        (F.col("a.n") * F.col("b.n") / (F.col("a.m") - 1) * dist("a.mid", "b.mid")).alias("d")
    )
    observed = pairs.agg(F.sum("d").alias("o"))
    total = g.agg(F.sum("n").alias("n"))
    expected = g.alias("a").crossJoin(F.broadcast(g.alias("b"))).agg(F.sum(F.col("a.n") * F.col("b.n") * dist("a.mid", "b.mid")).alias("e"))  # rating scale: a few values
    return observed.crossJoin(total).crossJoin(expected).select((1 - (F.col("n") - 1) * F.col("o") / F.col("e")).alias("alpha"))


def late_fusion(rows: DataFrame, a: str, b: str, alphas: list[float]) -> DataFrame:
    """ML06, JN12: for each weight of the mix of log odds, its average precision, best first by ap then by weight."""
    from ..functions.columns import logit, sigmoid

    grid = F.explode(F.array(*[F.lit(x) for x in alphas])).alias("alpha")  # each row meets every weight, in place
    mixed = rows.select("label", a, b, grid)
    score = sigmoid(F.col("alpha") * logit(F.col(a)) + (1 - F.col("alpha")) * logit(F.col(b)))
    return average_precision(mixed.select("alpha", "label", F.round(score, 9).alias("score")), ["alpha"]).orderBy(F.desc(F.round("ap", 12)), F.desc("alpha"))


def order_bounds(means: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """EV14: the bounds of the middle ``share`` of resampled means, as order statistics (the 25th and 976th of 1,000)."""
    w = Window.orderBy(value)  # one row per resample
    at = means.select(value, (F.row_number().over(w) - 1).alias("_i"), F.count("*").over(Window.partitionBy()).alias("_n"))
    low, high = F.floor(F.col("_n") * F.lit((1 - share) / 2)), F.floor(F.col("_n") * F.lit((1 + share) / 2))
    pick = lambda p: F.max(F.when(F.col("_i") == p, F.col(value)))
    return at.agg(pick(low).alias("low"), pick(high).alias("high"))


def covered(rows: DataFrame, value: str) -> DataFrame:
    """EV09: the rows that a tool has a value for, so that all are compared on the same ones."""
    return rows.where(F.col(value).isNotNull())


def score_table(rows: DataFrame, threshold: float, places: int = 3) -> DataFrame:
    """EV21: (split, rows, risky, flagged, mean_score) for display, rounded."""
    s = rows.groupBy("split").agg(F.count("*").alias("rows"), F.sum("label").alias("risky"), F.count_if(F.col("score") >= threshold).alias("flagged"), F.avg("score").alias("mean_score"))
    return s.withColumn("mean_score", F.round("mean_score", places))
